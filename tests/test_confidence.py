import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from escalade.functions.confidence import cascade, clip_confidence, confidence_gate, failure_risk, parse_confidence
from escalade.operators import calibration as cal
from escalade.operators import ranks

CASES = [
    ('{"PROBABILITY": 85}', 85), ("PROBABILITY: 42", 42), ("probability : 7", 7), ("  93  ", 93), ("I think about 60 percent", 60),
    ("", None), ("no number here", None), (None, None), ('{"PROBABILITY": 150}', 100), ('{"PROBABILITY": -5}', 0),
    ('{"PROBABILITY": 85.7}', 85), ("150", 100), ("maybe 150 or 40", 40), ("PROBABILITY: 1000", 100), ('{"PROBABILITY": true}', 1),
    ('{"PROBABILITY": "85.5"}', 85), ('{"probability": 12}', 12), ('{"PROBABILITY": "33"}', 33), ('{"PROBABILITY": null, "x": 5}', 5),
    ("{'PROBABILITY': 20}", 20), ('{"a": 5}', 5), ("[1]", 1), ("nan", None), ("None", None), ('{"PROBABILITY": 85} trailing 3', 85),
]


def test_parsing_cases(spark):
    df = spark.createDataFrame([(t, None if w is None else float(w)) for t, w in CASES], "t string, want double")
    for r in df.withColumn("got", parse_confidence("t")).collect():
        assert r["got"] == r["want"], r["t"]


def test_clipping_keeps_null(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), None), (-3.0, 0.0), (120.0, 100.0), (55.5, 55.5)], "c double, want double")
    for r in df.withColumn("got", clip_confidence("c")).collect():
        assert r["got"] == r["want"]


def test_gate_and_cascade(spark):
    df = spark.createDataFrame([(70.0,), (69.9,), (10.0,), (9.9,), (None,)], "c double")
    out = df.select(confidence_gate("c"), cascade("c", F.lit("broadcast"))).collect()
    assert [r[0] for r in out] == ["baseline_llm", "single_agent", "single_agent", "single_agent", "single_agent"]
    assert [r[1] for r in out] == ["baseline_llm", "single_agent", "single_agent", "broadcast", "broadcast"]


def brute_auroc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total = sum(y for y, _ in pairs)
    if total in (0, len(pairs)):
        return None
    out, tp, n = 0.0, 0, 0
    for s in sorted({s for _, s in pairs}, reverse=True):
        here = [y for y, v in pairs if v == s]
        tp, n = tp + sum(here), n + len(here)
        out += sum(here) / total * tp / n
    return out


def brute_ap_ordered(triples):
    hits, out = 0, 0.0
    for rank, (y, _, _) in enumerate(sorted(triples, key=lambda t: (-t[1], t[2])), start=1):
        if y:
            hits += 1
            out += hits / rank
    total = sum(t[0] for t in triples)
    return out / total if total else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    data = {"tied": [(rng.random() < 0.4, float(rng.randint(0, 12))) for _ in range(300)],
            "fine": [(rng.random() < 0.3, rng.random() * 100) for _ in range(400)],
            "one": [(True, float(i)) for i in range(20)]}
    flat = [(g, i, y, s) for g, v in data.items() for i, (y, s) in enumerate(v)]
    return data, spark.createDataFrame(flat, "g string, i bigint, y boolean, s double").persist()


@pytest.mark.parametrize("cut", [False, True])
def test_auroc_and_ap_against_pairs(scored, cut):
    data, df = scored
    points = ranks.split_points(df, "s", 16) if cut else None
    a = {r["g"]: r["auroc"] for r in cal.auroc(df, F.col("y"), F.col("s"), ["g"], points).collect()}
    p = {r["g"]: r["average_precision"] for r in cal.average_precision(df, F.col("y"), F.col("s"), ["g"], points).collect()}
    for g, pairs in data.items():
        for got, want in ((a[g], brute_auroc(pairs)), (p[g], brute_ap([(int(y), s) for y, s in pairs]))):
            assert (got is None) == (want is None)
            assert got is None or abs(got - want) < 1e-12


def test_a_group_of_distinct_scores_is_many_ranges(spark):
    """A third of all rows in one group, every score another one, and a group without a name: the ranges come from the sort alone."""
    from escalade.operators.ranks import by_ranges, running_totals

    n = 6000
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
    df = spark.range(n).select(g.alias("g"), F.xxhash64("id").alias("score"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = by_ranges(df, ["g"], "score")
        sizes = {r[0]: r[1] for r in ranged.where("g = 'hot'").groupBy("_range").count().collect()}
        assert len(sizes) >= 3 and max(sizes.values()) < n / 4
        for descending in (False, True):
            whole = running_totals(df, ["g"], "score", ["v"], descending, bounded=True)
            for cut in (running_totals(df, ["g"], "score", ["v"], descending), running_totals(ranged, ["g"], "score", ["v"], descending)):
                assert cut.columns == whole.columns and rows(cut) == rows(whole)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_auroc_mirror(scored):
    _, df = scored
    up = {r["g"]: r["auroc"] for r in cal.auroc(df, F.col("y"), F.col("s"), ["g"]).collect()}
    down = {r["g"]: r["auroc"] for r in cal.auroc(df, F.col("y"), -F.col("s"), ["g"]).collect()}
    assert all(abs(up[g] + down[g] - 1) < 1e-12 for g in ("tied", "fine"))


@pytest.mark.parametrize("cut", [False, True])
def test_ordered_ap_against_loop(scored, cut):
    data, df = scored
    points = ranks.split_points(df, "i", 8) if cut else None
    out = {r["g"]: r["average_precision"] for r in cal.average_precision_ordered(df, F.col("y"), F.col("s"), "i", ["g"], points).collect()}
    for g, pairs in data.items():
        assert abs(out[g] - brute_ap_ordered([(y, s, i) for i, (y, s) in enumerate(pairs)])) < 1e-12


def brute_bins(pairs, n=10):
    edges = [i * (1.0 / n) for i in range(n)] + [1.0]
    out = {}
    for i in range(n):
        lo, hi = edges[i], edges[i + 1]
        here = [(y, p) for y, p in pairs if (p > lo or (i == 0 and p == lo)) and p <= hi]
        if here:
            out[i] = (len(here), sum(p for _, p in here) / len(here), sum(y for y, _ in here) / len(here))
    return out


def test_bins_ece_brier_against_loop(spark):
    rng = random.Random(3)
    pairs = [(rng.random() < 0.5, c / 100) for c in range(101) for _ in range(3)]
    df = spark.createDataFrame(pairs, "y boolean, p double")
    want = brute_bins([(int(y), p) for y, p in pairs])
    got = {r["bin"]: (r["n"], r["mean_probability"], r["empirical_rate"]) for r in cal.reliability_bins(df, F.col("y"), F.col("p")).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][0] == v[0] and all(abs(a - b) < 1e-12 for a, b in zip(got[k], v))
    ece = sum(n * abs(m - r) for n, m, r in want.values()) / len(pairs)
    assert abs(cal.ece(df, F.col("y"), F.col("p")).first()["ece"] - ece) < 1e-12
    br = sum((p - y) ** 2 for y, p in pairs) / len(pairs)
    assert abs(cal.brier(df, F.col("y"), F.col("p")).first()["brier"] - br) < 1e-12


def test_report_counts_unparseable_rows_and_keeps_undefined_null(spark):
    df = spark.createDataFrame(
        [("a", 90.0, True), ("a", None, False), ("a", 20.0, False), ("b", None, True), ("c", 50.0, True)],
        "setting string, confidence double, baseline_correct boolean",
    )
    out = {r["setting"]: r for r in cal.confidence_report(df, "setting").collect()}
    assert (out["a"]["n_total"], out["a"]["n_parseable"], out["a"]["failure_auroc"]) == (3, 2, 1.0)
    assert (out["b"]["n_parseable"], out["b"]["parse_rate"], out["b"]["brier"], out["b"]["ece"]) == (0, 0.0, None, None)
    assert out["c"]["failure_auroc"] is None and out["c"]["mean_conf_wrong"] is None


def test_sweep_best_threshold(spark):
    df = spark.createDataFrame([("s", 80.0, True, False), ("s", 40.0, False, True), ("s", None, True, True)],
                               "setting string, confidence double, baseline_correct boolean, single_correct boolean")
    out = {r["threshold"]: r for r in cal.threshold_sweep(df, [0.0, 50.0, 90.0]).collect()}
    assert [out[t]["solved"] for t in (0.0, 50.0, 90.0)] == [2, 3, 2]
    assert [t for t in out if out[t]["is_best"]] == [50.0]


def test_risk_direction(spark):
    assert spark.range(1).select(failure_risk(F.lit(85.0))).first()[0] == pytest.approx(0.15)
    assert not math.isnan(0.15)


def test_report_and_sweep_without_groups(spark):
    df = spark.createDataFrame([(90.0, True, False), (10.0, False, True), (None, True, True)],
                               "confidence double, baseline_correct boolean, single_correct boolean")
    r = cal.confidence_report(df).first()
    assert (r["n_total"], r["n_parseable"], r["failure_auroc"]) == (3, 2, 1.0) and "_all" not in r.asDict()
    assert [x["threshold"] for x in cal.threshold_sweep(df, [50.0, 95.0], by=()).where("is_best").collect()] == [50.0]


def test_continuous_scores_through_the_report(spark):
    df = spark.range(0, 300).select((F.col("id") * 0.31).alias("confidence"), (F.col("id") % 3 == 0).alias("baseline_correct"), F.lit("s").alias("setting"))
    points = ranks.split_points(df.select((F.lit(1.0) - F.col("confidence") / 100).alias("r")), "r", 12)
    plain, cut = cal.confidence_report(df, "setting").first(), cal.confidence_report(df, "setting", points=points).first()
    assert plain["failure_auroc"] == cut["failure_auroc"]


def test_numbers_pass_through_and_are_clipped(spark):
    from escalade.functions.confidence import read_confidence

    values = [85.7, 0.93, 1000.0, -3.0, float("nan"), None]
    frame = spark.createDataFrame([(v, None if v is None else str(v)) for v in values], "number double, cell string").coalesce(1)
    got = frame.select(read_confidence(frame, "number").alias("a"), read_confidence(frame, "cell").alias("b")).collect()
    assert [r["a"] for r in got] == [85.7, 0.93, 100.0, 0.0, None, None] == [r["b"] for r in got]
    text = spark.createDataFrame([('{"PROBABILITY": 86}',), ("about 40 percent",), ("70",)], "cell string").coalesce(1)
    assert [r[0] for r in text.select(read_confidence(text, "cell")).collect()] == [86.0, 40.0, 70.0]
