import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from escalade.dims import OUTCOME_COLUMNS, REQUIRED_COLUMNS, SETTINGS, setting_dim
from escalade.operators import features as ft
from escalade.operators.leakage import LeakageError, assert_no_leakage, is_forbidden
from escalade.operators.matched import MatchedTableError
from escalade.session import new_folder, shared_dir
from escalade.sources import problems as pb
from escalade.sources import tables as tb


def dim(spark, *names):
    return setting_dim(spark, [(n, "solver", n.upper(), i, i) for i, n in enumerate(names)])


def write_csv(path, records, columns=None):
    cols = columns or list(records[0])
    lines = [",".join(cols)] + [",".join('"' + str(r[c]).replace('"', '""') + '"' for c in cols) for r in records]
    path.write_text("\n".join(lines) + "\n")


def record(uid, setting, **cells):
    base = {c: "x" for c in REQUIRED_COLUMNS} | {"setting": setting, "problem_uid": uid} | {c: "0" for c in OUTCOME_COLUMNS.values()}
    return base | {"confidence_raw": '{"PROBABILITY": 86}', "difficulty_tier": "3", "broadcast_tokens": "12"} | cells


def test_folder_of_files(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [record("1", "s1", single_correct="1"), record("2", "s1")])
    write_csv(tmp_path / "b.csv", [record("1", "s2", baseline_correct="True")])
    write_csv(tmp_path / "c.csv", [record("1", "other")])
    out = tb.read_matched(spark, str(tmp_path), dim(spark, "s1", "s2"))
    assert rows(out.select("setting", "problem_uid", "oracle_label", "difficulty_tier", "broadcast_tokens", "confidence_raw")) == [
        ("s1", "1", "single_agent", 3, 12, '{"PROBABILITY": 86}'), ("s1", "2", "none", 3, 12, '{"PROBABILITY": 86}'),
        ("s2", "1", "baseline_llm", 3, 12, '{"PROBABILITY": 86}')]
    assert tb.read_matched(spark, str(tmp_path), dim(spark, "s1"), strict=False).count() == 4
    with pytest.raises(MatchedTableError, match="missing settings"):
        tb.read_matched(spark, str(tmp_path), dim(spark, "s1", "s9"))


def test_one_setting_in_two_files_or_two_in_one(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [record("1", "s1")])
    write_csv(tmp_path / "b.csv", [record("2", "s1")])
    with pytest.raises(MatchedTableError, match="more than one"):
        tb.read_matched(spark, str(tmp_path), dim(spark, "s1"))
    two = tmp_path / "two"
    two.mkdir()
    write_csv(two / "a.csv", [record("1", "s1"), record("2", "s2")])
    with pytest.raises(MatchedTableError, match="mixed_settings"):
        tb.read_matched(spark, str(two), dim(spark, "s1", "s2"))


def test_combined_file_is_renamed_and_relabelled(spark, tmp_path):
    r = record("1", "s1", per_correct="1")
    r = {("setting_id" if k == "setting" else "problem_id" if k == "problem_uid" else k): v for k, v in r.items()} | {"oracle_label": "none"}
    write_csv(tmp_path / "all.csv", [r, r | {"setting_id": "s2"}])
    out = tb.read_matched(spark, str(tmp_path / "all.csv"), dim(spark, "s1", "s2"))
    assert {(x["oracle_label"], x["oracle_cheapest_successful"]) for x in out.collect()} == {("planner_executor_reviewer", "none")}


def test_round_trip_with_many_part_files(spark, tmp_path):
    data = spark.createDataFrame([tuple(record(str(i), f"s{i % 2}")[c] for c in REQUIRED_COLUMNS) for i in range(40)], ", ".join(f"{c} string" for c in REQUIRED_COLUMNS))
    tb.write_matched(data.repartition(4), str(tmp_path / "t"))
    assert tb.read_matched(spark, str(tmp_path / "t"), dim(spark, "s0", "s1"), unit="folder").count() == 40


def test_keyed_tables_need_their_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("problem_uid,predicted_label,extra\n1,per,x\n")
    assert rows(tb.read_table(spark, str(tmp_path / "p.csv"), "predictions")) == [("1", "per")]
    with pytest.raises(MatchedTableError):
        tb.read_table(spark, str(tmp_path / "p.csv"), "split")


def test_report_refuses_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", 1)], "name string, n int")
    tb.write_report(df, str(tmp_path / "r"), "csv", ["n", "name"])
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["n", "name"]
    with pytest.raises(ValueError):
        tb.write_report(df.where("n > 1"), str(tmp_path / "e"))


PROBLEMS = [
    {"question": "Q1?", "answer": "None", "answer_number": "3/8", "equation_solution": "because", "difficulty": 1.0, "domain": "['A -> B']", "source": "f"},
    {"id": "own", "problem": " Q2 ", "answer": " 5 ", "label": "L", "tools": "t", "extra": "e"},
]


def test_two_loaders_disagree_on_the_answer(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(json.dumps(p) for p in PROBLEMS) + "\n\n")
    omni = {r["input"]: r for r in pb.load_problems(spark, str(path), "omnimath", 2).collect()}
    plain = {r["input"]: r for r in pb.load_problems(spark, str(path), "generic_jsonl").collect()}
    assert (omni["Q1?"]["answer"], plain["Q1?"]["answer"]) == ("3/8", "None")
    assert (omni["Q1?"]["reference_solution"], plain["Q1?"]["reference_solution"]) == ("because", "")
    assert omni["Q2"]["id"] == "own" and omni["Q1?"]["id"].startswith("omnimath_") and plain["Q1?"]["id"].startswith("row_")
    assert omni["Q1?"]["metadata"] == {"difficulty": "1.0", "domain": "['A -> B']", "source": "f"}
    assert plain["Q2"]["metadata"] == {"extra": "e"}
    with pytest.raises(pb.ProblemFileError):
        pb.load_problems(spark, str(path), "omnimath", 3)


def test_bad_problem_lines_are_located(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"question": "q", "answer": "a"}\nnot json\n{"answer": "a"}\n{"question": "q"}\n[1]\n')
    good, bad = pb.read_problems(spark, str(path))
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["invalid_json", "invalid_json", "no_answer", "no_question"]
    with pytest.raises(pb.ProblemFileError):
        pb.load_problems(spark, str(path))


def test_loader_names():
    assert pb.normalize_loader(None) == "jsonl" and pb.normalize_loader("OmniMath") == "omni-math"
    with pytest.raises(pb.ProblemFileError):
        pb.normalize_loader("parquet")


def test_bad_lines_have_numbers(spark, tmp_path):
    lines = ['{"question": "q", "answer": "a"}', "", "x" * 200, '{"question": "", "answer": "a"}', "  ", '{"question": "q"}']
    (tmp_path / "p.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "q.jsonl").write_text("bad\n")
    _, bad = pb.read_problems(spark, str(tmp_path))
    got = sorted((r["file"].rsplit("/", 1)[1], r["line_number"], r["reason"], r["line"]) for r in bad.collect())
    assert got == [("p.jsonl", 3, "invalid_json", "x" * 200), ("p.jsonl", 4, "no_question", lines[3]), ("p.jsonl", 6, "no_answer", lines[5]), ("q.jsonl", 1, "invalid_json", "bad")]
    with pytest.raises(pb.ProblemFileError, match="line 3"):
        pb.load_problems(spark, str(tmp_path))


def test_fingerprint_is_order_free_and_sensitive(spark):
    df = spark.createDataFrame([(str(i), f"q{i}", f"a{i}") for i in range(50)], "id string, input string, answer string")
    a = rows(pb.fingerprint(df))
    assert rows(pb.fingerprint(df.orderBy(F.rand(1)).repartition(7))) == a
    assert rows(pb.fingerprint(df.withColumn("answer", F.when(F.col("id") == "3", "other").otherwise(F.col("answer"))))) != a


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x").startswith(shared_dir(spark)) and new_folder(spark, "x") != new_folder(spark, "x")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)


@pytest.mark.parametrize("name", ["baseline_correct", " Oracle_Label ", "baseline_success", "verdict", "per_solved", "gold_x", "first_success_protocol", "y_true",
                                  "is_failure", "cheapest", "my_score", "x_wrong", "outcome"])
def test_forbidden_names(name):
    assert is_forbidden(name)
    with pytest.raises(LeakageError):
        assert_no_leakage([name])


@pytest.mark.parametrize("name", ["problem", "source", "domain", "difficulty", "difficulty_tier", "goldfish", "labels_count", "feature_17", "scored"])
def test_allowed_names(name):
    assert not is_forbidden(name)


def test_spec_and_frame_refuse_outcomes(spark):
    with pytest.raises(LeakageError):
        ft.FeatureSpec(numeric=("baseline_correct",))
    df = spark.createDataFrame([("p", "s", "d", 1.0, 1, True)], "problem string, source string, domain string, difficulty double, difficulty_tier int, baseline_correct boolean")
    assert ft.feature_frame(df, ft.TEXT_METADATA).columns == ft.TEXT_METADATA.columns()
    with pytest.raises(KeyError):
        ft.feature_frame(df.drop("domain"), ft.TEXT_METADATA)
    assert len(SETTINGS) == 10
