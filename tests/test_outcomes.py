import itertools

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from escalade.dims import ALIASES, ESCALATION_RANK, EXECUTIONS, LABELS, OUTCOME_COLUMNS, REQUIRED_COLUMNS, SETTINGS
from escalade.functions.outcomes import (
    any_solved,
    canonical_protocol,
    difficulty_tier,
    display_name,
    escalation_direction,
    lenient_outcome,
    oracle_label,
    strict_outcome,
    truthy,
)
from escalade.operators import matched as mt


def patterns(spark):
    cells = list(itertools.product([True, False], repeat=4))
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], ["i", *OUTCOME_COLUMNS.values()])


def test_label_is_first_success_for_all_sixteen_patterns(spark):
    for r in patterns(spark).withColumn("label", oracle_label()).withColumn("any", any_solved()).collect():
        won = [p for p in EXECUTIONS if r[OUTCOME_COLUMNS[p]]]
        assert r["label"] == (won[0] if won else "none")
        assert r["any"] == bool(won)


def test_every_alias_resolves_and_unknown_fails(spark):
    df = spark.createDataFrame([(f"  {k.upper()} ", v) for k, v in ALIASES.items()], ["s", "want"])
    assert all(r["got"] == r["want"] for r in df.withColumn("got", canonical_protocol("s")).collect())
    bad = spark.createDataFrame([("baselin",), (None,)], "s string")
    assert [r[0] for r in bad.select(canonical_protocol("s", on_error="null")).collect()] == [None, None]
    for value in ("baselin", None):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(value,)], "s string").select(canonical_protocol("s")).collect()
    assert spark.createDataFrame([("per",)], "s string").select(display_name("s")).first()[0] == "PER"


def test_strict_outcome_rejects_missing_and_unknown(spark):
    good = spark.createDataFrame([("1", True), (" TRUE", True), ("t", True), ("Yes", True), ("1.0", True), ("0", False),
                                  ("false", False), ("F", False), ("no", False), ("0.0", False)], "v string, want boolean")
    assert all(r["want"] == r["got"] for r in good.withColumn("got", strict_outcome("v")).collect())
    for value in (None, "", "unknown", "NaN", "2", "0.5"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(value,)], "v string").select(strict_outcome("v")).collect()


def test_lenient_outcome_reads_float_text_as_failure(spark):
    df = spark.createDataFrame([("1", True), ("True", True), ("1.0", False), ("yes", False), (None, False), ("", False)], "v string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", lenient_outcome("v")).collect())


def test_truncated_row_gets_no_label(spark):
    df = spark.createDataFrame([(True, None, False, False)], "baseline_correct boolean, single_correct boolean, per_correct boolean, broadcast_correct boolean")
    assert df.select(oracle_label()).first()[0] is None


def test_escalation_ranks(spark):
    pairs = [(p, g) for p in LABELS for g in LABELS]
    df = spark.createDataFrame(pairs, ["p", "g"]).withColumn("d", escalation_direction("p", "g"))
    for r in df.collect():
        a, b = ESCALATION_RANK[r["p"]], ESCALATION_RANK[r["g"]]
        assert r["d"] == ("over" if a > b else "under" if a < b else "match")


def test_tier_is_half_even_and_keeps_null(spark):
    cases = [(0.2, 1), (0.5, 1), (1.5, 2), (2.5, 2), (3.5, 4), (9.5, 10), (11.0, 10), (None, None)]
    df = spark.createDataFrame(cases, "x double, want int").withColumn("got", difficulty_tier("x"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_truthy(spark):
    df = spark.createDataFrame([("", False), (None, False), ("[]", False), ("proof", True), ("0", False)], "v string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", truthy("v")).collect())


def matched_row(uid="u1", setting="s", **cells):
    base = {c: "x" for c in REQUIRED_COLUMNS} | {"setting": setting, "problem_uid": uid} | {c: "1" for c in OUTCOME_COLUMNS.values()}
    return base | cells


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in REQUIRED_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in REQUIRED_COLUMNS))


@pytest.mark.parametrize("column", REQUIRED_COLUMNS)
def test_each_required_column_is_required(spark, column):
    df = frame(spark, [matched_row()]).drop(column)
    with pytest.raises(mt.MatchedTableError):
        mt.require_columns(df)


def test_validation_by_corruption(spark):
    assert mt.validate_matched(frame(spark, [matched_row("a"), matched_row("b")])).isEmpty()
    mt.assert_valid(frame(spark, [matched_row("a")]))
    for bad in (
        [matched_row("a"), matched_row("a")],
        [matched_row("a", per_correct="2")],
        [matched_row("a", per_correct=None)],
        [matched_row("a", broadcast_correct="unknown")],
    ):
        with pytest.raises(mt.MatchedTableError):
            mt.assert_valid(frame(spark, bad))
    with pytest.raises(mt.MatchedTableError):
        mt.assert_valid(frame(spark, []))


def test_mixed_settings_in_one_source(spark):
    df = frame(spark, [matched_row("a", "s1"), matched_row("b", "s2")]).withColumn("file", F.lit("f.csv"))
    out = mt.validate_matched(df, "file").collect()
    assert [(r["check"], r["examples"]) for r in out] == [("mixed_settings", "f.csv")]


def test_violations_count_all_but_show_five(spark):
    df = frame(spark, [matched_row(f"u{i:03d}") for i in range(50)] * 2)
    r = mt.validate_matched(df).first()
    assert (r["check"], r["n_bad"]) == ("duplicate_uid", 50)
    assert r["examples"] == "u000, u001, u002, u003, u004"


def test_stored_label_is_kept_and_recomputed(spark):
    df = frame(spark, [matched_row("a", baseline_correct="0")]).withColumn("oracle_label", F.lit("none"))
    r = mt.with_oracle_label(df, parse=True).first()
    assert (r["oracle_label"], r["oracle_cheapest_successful"]) == ("single_agent", "none")


def test_incomplete_problems_are_set_aside(spark):
    runs = spark.createDataFrame(
        [("s", "a", p, True, 10) for p in ("baseline", "Single", "per", "broadcast")] + [("s", "b", "baseline", True, 5)],
        "setting string, problem_uid string, protocol string, passed boolean, tokens bigint",
    )
    full, rest = mt.matched_outcomes(runs)
    assert [r["problem_uid"] for r in full.collect()] == ["a"]
    assert [(r["problem_uid"], r["n_protocols"]) for r in rest.collect()] == [("b", 1)]


def test_shares_cover_all_labels_and_empty_input(spark):
    df = patterns(spark).withColumn("oracle_label", oracle_label())
    r = mt.oracle_shares(df).first().asDict()
    assert len(r) == 5 and abs(sum(r.values()) - 100.0) < 1e-9
    assert set(mt.oracle_shares(df.where("i < 0")).first().asDict().values()) == {0.0}


def test_setting_registry_orders():
    assert sorted(s[3] for s in SETTINGS) == list(range(1, 11))
    assert sorted(s[4] for s in SETTINGS) == list(range(1, 11))


def test_tier_of_nan_is_null(spark):
    from escalade.functions.outcomes import difficulty_tier

    frame = spark.createDataFrame([(float("nan"),), (None,), (2.5,), (99.0,)], "d double").coalesce(1)
    assert [r[0] for r in frame.select(difficulty_tier("d")).collect()] == [None, None, 2, 10]
