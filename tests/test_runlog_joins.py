from pyspark.sql import functions as F
import pytest

from conftest import rows
from escalade.operators import filters, joins, runlog


def test_fold_stops_at_the_first_pass(spark):
    df = spark.createDataFrame([("a", 0, False, "x"), ("a", 1, True, "y"), ("a", 2, False, "z"), ("b", 0, False, "p"), ("b", 1, False, "q"), ("b", 9, True, "r")],
                               "problem_id string, round int, passed boolean, answer string")
    out = {r["problem_id"]: tuple(r)[1:] for r in runlog.fold_rounds(df, 3).collect()}
    assert out == {"a": (True, 2, "evaluator_pass", "y"), "b": (False, 2, "max_rounds_exhausted", "q")}


def test_last_n_renumbers_and_trail_keeps_numbers(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 0)], "k string, t int")
    assert rows(runlog.last_n(df, ["k"], "t", 3)) == [("a", 7, 1), ("a", 8, 2), ("a", 9, 3), ("b", 0, 1)]
    trail = {(r["k"], r["t"]): (r["event_id"], r["parent_event_id"]) for r in runlog.revision_trail(df, ["k"], "t", 2).collect()}
    assert trail == {("a", 8): (9, 8), ("a", 9): (10, 9), ("b", 0): (1, None)}


def polls(spark):
    return spark.createDataFrame(
        [(1, 0, 0, 80, "x", "", ""), (1, 0, 1, 80, "because", "", "\\boxed{1}"), (1, 0, 2, 70, "", "n/a", ""), (1, 0, 3, 65, "", "", "\\boxed{2}"), (2, 0, 0, 5, "", "", "")],
        "problem_id int, turn int, peer_idx int, score int, reason string, intent string, candidate string",
    )


def test_speaker_ties_deferred_and_proposals(spark):
    p = polls(spark)
    assert rows(runlog.speaker_argmax(p)) == [(1, 0, 0, 80), (2, 0, 0, 5)]
    assert sorted(r["peer_idx"] for r in runlog.deferred_peers(p, 60).collect()) == [1, 3]
    assert rows(runlog.best_proposal(p)) == [(1, 0, "\\boxed{1}", 1), (2, 0, None, None)]


def test_votes(spark):
    v = spark.createDataFrame([(1, 0, True, "\\boxed{a}", 1), (1, 0, True, "so \\boxed{b}", 2), (1, 0, False, "\\boxed{b}", 3), (1, 0, False, "\\boxed{a}", 4), (2, 0, True, "", 1)],
                              "problem_id int, approval_round int, approve boolean, revised_answer string, seq int")
    una = {r["problem_id"]: r["approved"] for r in runlog.approval_vote(v).collect()}
    maj = {r["problem_id"]: r["approved"] for r in runlog.approval_vote(v, "majority").collect()}
    assert (una, maj) == ({1: False, 2: True}, {1: False, 2: True})
    pick = {p: {r["problem_id"]: r["candidate"] for r in runlog.choose_candidate(v, p).collect()} for p in ("majority_revision", "first_revision", "latest_revision")}
    assert pick == {p: {1: "\\boxed{a}", 2: None} for p in pick}


def test_ledger_total_equals_roles(spark):
    calls = spark.createDataFrame([("p", "a", 1, 2, 0, ""), ("p", "a", 3, 4, 3, "err"), ("p", "b", 5, 6, 1, None)],
                                  "problem_id string, role string, prompt_tokens bigint, completion_tokens bigint, attempts int, error string")
    out = {r["role"]: r for r in runlog.token_ledger(calls).collect()}
    assert (out[None]["total_tokens"], out[None]["calls"], out[None]["http_attempts"], out[None]["failed_calls"]) == (21, 3, 5, 1)
    assert out["a"]["http_attempts"] == 4


def test_reconcile_pairs_and_multisets(spark):
    a = spark.createDataFrame([("1", "t one", True), ("2", "t two", True), ("3", "dup", True), ("4", "dup", False), ("5", "dup2", True), ("6", "dup2", True), ("7", "left", True)], "uid string, text string, ok boolean")
    b = spark.createDataFrame([("x", " t  one ", True), ("y", "t two", False), ("z", "dup", False), ("w", "dup", True), ("v", "dup2", True), ("u", "dup2", False), ("q", "right", True)], "uid string, text string, ok boolean")
    out = {r["status"]: r for r in joins.reconcile(a, b, "text", "uid", ["ok"]).collect()}
    assert set(out) == {"pair_agrees", "pair_differs", "group_agrees", "group_differs", "only_a", "only_b"}
    assert (out["pair_differs"]["uid_a"], out["pair_differs"]["uid_b"], out["pair_differs"]["ok_a"], out["pair_differs"]["ok_b"]) == ("2", "y", True, False)
    assert out["group_differs"]["uid_a"] is None


def test_hot_text_group_is_counted_not_collected(spark):
    hot = spark.range(0, 20000).select(F.col("id").cast("string").alias("uid"), F.lit("same text").alias("text"), (F.col("id") % 2 == 0).alias("ok"))
    r = joins.reconcile(hot, hot.repartition(5), "text", "uid", ["ok"]).first()
    assert (r["status"], r["n_a"], r["n_b"]) == ("group_agrees", 20000, 20000)
    assert joins.drop_ambiguous(hot, "text").isEmpty()


def test_diff_finds_cells_rows_and_columns(spark):
    ref = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, v double, s string")
    assert joins.table_diff(ref, ref, ["k"]).isEmpty()
    assert joins.table_diff(ref.withColumn("v", F.col("v") + 0.001), ref, ["k"], 0.01).isEmpty()
    got = {(r["k"], r["column"]) for r in joins.table_diff(ref.where("k = 'a'").withColumn("v", F.lit(9.0)), ref, ["k"]).collect()}
    assert {("a", "v"), ("b", "<row>")} <= got and ("a", "s") not in got
    assert [(r["column"], r["reference"]) for r in joins.table_diff(ref.drop("s"), ref, ["k"]).collect()] == [("s", "<missing column>")]


def test_prediction_join_guards(spark):
    m = spark.createDataFrame([("a",), ("b",)], "problem_uid string")
    p = spark.createDataFrame([("a", "per"), ("c", "per")], "problem_uid string, predicted_label string")
    assert joins.join_predictions(m, p).count() == 1
    assert rows(joins.unjoined(p, m)) == [("c", "per")]
    with pytest.raises(ValueError):
        joins.join_predictions(m, p.unionByName(p))
    with pytest.raises(ValueError):
        joins.join_predictions(m, p.where("problem_uid = 'c'"))


def test_raw_ids_match_nothing_without_the_crosswalk(spark):
    a = spark.createDataFrame([("omni:1", "s"), ("omni:2", "s")], "uid_a string, setting string")
    b = spark.createDataFrame([("o_1",), ("o_2",)], "uid_b string")
    x = spark.createDataFrame([("omni:1", "o_1")], "uid_a string, uid_b string")
    r = joins.crosswalk_coverage(a, b, x).first()
    assert (r["n"], r["n_matched"], r["n_raw_matched"], r["coverage"]) == (2, 1, 0, 0.5)


def test_row_leakage(spark):
    df = spark.createDataFrame([("what is abc", "abc", {"k": "v"}), ("q", "ab", {"gold_answer": "x", "answer_key": "y"}), ("q", None, {})],
                               "input string, answer string, metadata map<string,string>")
    out = [(r["leaked_keys"], r["hard_fail"], r["answer_in_prompt"]) for r in filters.row_leakage(df).collect()]
    assert out == [([], False, True), (["answer_key", "gold_answer"], True, False), ([], False, False)]


def test_value_leakage_sees_a_renamed_outcome(spark):
    df = spark.range(0, 200).select((F.col("id") % 2 == 0).alias("feature_17"), (F.col("id") % 7).alias("noise"),
                                    F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("label"))
    out = {r["feature"]: r["purity"] for r in filters.value_leakage(df, ["feature_17", "noise"], "label").collect()}
    assert out["feature_17"] == 1.0 and out["noise"] < 0.6


def test_artifact_split_keeps_reasons(spark):
    df = spark.createDataFrame([("As shown in the FIGURE, see figure 2",), ("plain",), (None,)], "t string")
    kept, out = filters.split_missing_artifact(df, "t")
    assert kept.count() == 2 and out.first()["reasons"] == ["as shown in the figure", "see figure"]


def test_table_diff_counts_rows_and_names_missing_columns(spark):
    from escalade.operators.joins import table_diff

    one = spark.createDataFrame([("a", 1.0)], "k string, x double")
    twice = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, x double")
    assert rows(table_diff(twice, one, ["k"])) == [("a", "<row>", "2", "1")] and rows(table_diff(one, one, ["k"])) == []
    assert rows(table_diff(one.where("1 = 0"), one, ["k"])) == [("a", "<row>", "0", "1")]
    assert rows(table_diff(one.drop("x"), one.where("1 = 0"), ["k"])) == [("a", "<row>", "1", "0"), (None, "x", None, "<missing column>")]
    assert rows(table_diff(one, one.withColumn("x", F.lit(1.5)), ["k"], 0.1)) == [("a", "x", "1.0", "1.5")]


def test_unique_rows_may_hold_maps(spark):
    from escalade.operators.joins import drop_ambiguous

    table = spark.createDataFrame([("a", {"x": "1"}), ("b", {"x": "2"}), ("b", {"x": "3"})], "k string, metadata map<string,string>")
    assert [r["metadata"] for r in drop_ambiguous(table, "k").collect()] == [{"x": "1"}]


def test_revisions_without_a_box_do_not_count(spark):
    from escalade.operators.runlog import choose_candidate

    votes = spark.createDataFrame([(1, 1, 1, "x 3"), (1, 1, 2, "x 3"), (1, 1, 3, "so \\boxed{4}"), (2, 1, 1, "none")], "problem_id int, approval_round int, seq int, revised_answer string")
    for policy in ("majority_revision", "latest_revision", "first_revision"):
        assert rows(choose_candidate(votes, policy)) == [(1, 1, "\\boxed{4}"), (2, 1, None)]
