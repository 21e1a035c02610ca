import numpy as np
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from escalade.operators import resample as rs


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 600).select(
        F.col("id").cast("string").alias("problem_uid"), F.lit("s").alias("setting"),
        (F.crc32(F.col("id").cast("string")) % 10 < 6).alias("a"), (F.crc32(F.concat(F.lit("b"), F.col("id").cast("string"))) % 10 < 7).alias("b"),
        (F.col("id") % 17).alias("tokens"),
    ).persist()


@pytest.mark.parametrize("mode", ["rows", "cells"])
def test_same_seed_same_interval_whatever_the_partitioning(table, mode):
    a = rows(rs.bootstrap_ci(table, "a", ["setting"], n=100, mode=mode))
    assert rows(rs.bootstrap_ci(table.repartition(11), "a", ["setting"], n=100, mode=mode)) == a
    assert rows(rs.bootstrap_ci(table, "a", ["setting"], n=100, seed=43, mode=mode)) != a


@pytest.mark.parametrize("mode", ["rows", "cells"])
def test_interval_brackets_the_point_and_has_the_right_width(table, mode):
    r = rs.bootstrap_ci(table, "a", ["setting"], n=400, mode=mode).first()
    assert r["ci_low"] < r["point"] < r["ci_high"]
    width = 2 * 1.96 * (r["point"] * (1 - r["point"]) / 600) ** 0.5
    assert r["ci_high"] - r["ci_low"] == pytest.approx(width, rel=0.2)


@pytest.mark.parametrize("cell", [["a", "b"], ["problem_uid", "a"], []])
def test_multinomial_draws_exactly_n(table, cell):
    """Every replicate adds up to the rows, for four cells and for as many cells as rows (two levels of the tree)."""
    cells = rs.multinomial_cells(table, cell, n=50)
    totals = cells.groupBy("replicate").agg(F.sum("w").alias("n")).collect()
    assert len(totals) == 50 and {r["n"] for r in totals} == {600}
    assert rows(cells) == rows(rs.multinomial_cells(table.repartition(3), cell, n=50))


def test_multinomial_agrees_with_the_counts(table):
    cells = rs.multinomial_cells(table, ["problem_uid", "a"], n=400)
    share = cells.groupBy("replicate").agg((F.sum(F.when(F.col("a"), F.col("w")).otherwise(0)) / F.sum("w")).alias("p"))
    mean, spread = share.agg(F.avg("p"), F.stddev("p")).first()
    p = table.where("a").count() / 600
    assert mean == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / 600 / 400)) and spread == pytest.approx(math.sqrt(p * (1 - p) / 600), rel=0.15)


def test_cells_and_rows_give_like_bounds(table):
    for fn, args in ((rs.bootstrap_ci, ("a", ["setting"])), (rs.paired_difference, ("a", "b", ["setting"]))):
        x, y = fn(table, *args, mode="cells").first(), fn(table, *args, mode="rows").first()
        width = y["ci_high"] - y["ci_low"]
        assert x["point"] == y["point"] and abs(x["ci_low"] - y["ci_low"]) < 0.15 * width and abs(x["ci_high"] - y["ci_high"]) < 0.15 * width


def test_numeric_arms_and_means(table):
    scored = table.withColumns({"x": F.when(F.col("a"), 0.9).otherwise(0.2), "y": F.lit(0.5)})
    got = rs.paired_difference(scored, "x", "y", ["setting"], n=200).first()
    want = scored.agg(F.avg(F.col("x") - F.col("y"))).first()[0]
    assert got["point"] == pytest.approx(want) and got["ci_low"] < want < got["ci_high"]
    assert rs.mean_ci(scored, "x", ["setting"], n=50).first()["point"] == pytest.approx(want + 0.5)


@pytest.mark.parametrize("mode", ["rows", "cells"])
def test_same_arm_has_zero_width(table, mode):
    r = rs.paired_difference(table, "a", "a", ["setting"], n=50, mode=mode).first()
    assert (r["point"], r["ci_low"], r["ci_high"]) == (0.0, 0.0, 0.0)


def test_pairing_narrows_the_interval(table):
    flip = table.withColumn("c", F.when(F.col("tokens") == 0, ~F.col("a")).otherwise(F.col("a")))
    paired = rs.paired_difference(flip, "c", "a", ["setting"], n=200).first()
    apart = rs.paired_difference(flip, "b", "a", ["setting"], n=200).first()
    assert paired["ci_high"] - paired["ci_low"] < apart["ci_high"] - apart["ci_low"]


def test_missing_arm_is_an_error(spark, table):
    broken = table.withColumn("a", F.when(F.col("problem_uid") != "5", F.col("a")))
    with pytest.raises(Exception, match="align"):
        rs.paired_difference(broken, "a", "b", ["setting"], n=4).collect()
    assert [r[0] for r in rs.misaligned(table, table.where("problem_uid <> '7'")).collect()] == ["7"]


def test_empty_input_gives_nulls(table):
    assert rs.bootstrap_ci(table.where("1 = 0"), "a", n=10).first()["point"] is None


def test_row_weights_are_poisson_one(table):
    w = rs.weighted_cells(table, (), ["problem_uid"], n=40, mode="rows").where("replicate >= 0").agg(F.avg("w"), F.var_samp("w")).first()
    assert w[0] == pytest.approx(1.0, abs=0.03) and w[1] == pytest.approx(1.0, abs=0.06)


def test_measures_need_row_weights(table):
    with pytest.raises(ValueError):
        rs.weighted_cells(table, measures=["tokens"])


def test_point_equals_the_plain_mean(table):
    for mode in ("rows", "cells"):
        r = rs.bootstrap_ci(table, "a", ["setting"], n=8, mode=mode).first()
        assert (r["n"], r["point"]) == (600, table.where("a").count() / 600)


def test_cell_draws_extend_with_more_replicates(table):
    few = rs.weighted_cells(table, (), ["a"], n=100).where("replicate < 100")
    many = rs.weighted_cells(table, (), ["a"], n=250).where("replicate < 100")
    assert rows(few) == rows(many)


def test_a_task_hands_on_one_row_a_group(monkeypatch):
    """Sums of all replicates against single hashes; groups that no longer fit are handed on in parts."""
    import hashlib

    import pyarrow as pa

    n, units = 30, [f"u{k}" for k in range(300)]
    batch = pa.RecordBatch.from_pydict({"g": pa.array([k % 3 for k in range(300)]), "m": pa.array([None if k == 9 else k for k in range(300)], pa.int64()), "_unit": pa.array(units)})
    edges = [math.ceil(t * rs.UNIT) for t in rs.poisson_thresholds()]

    def weight(unit, replicate):
        h = hashlib.md5(f"7|{replicate // 4}|{unit}".encode()).hexdigest()
        bits = int(h[8 * (replicate % 4):8 * (replicate % 4) + 8], 16)
        return sum(bits >= e for e in edges)

    halves = [batch.slice(0, 120), batch.slice(120)]
    out = [r for b in rs._row_sums(["g"], {"m": "bigint"}, n, 7)(iter(halves)) for r in b.to_pylist()]
    assert sorted(r["g"] for r in out) == [0, 1, 2]
    for r in out:
        own = [k for k in range(300) if k % 3 == r["g"]]
        assert r["w"] == [100] + [sum(weight(units[k], i) for k in own) for i in range(n)]
        assert r["m"] == [sum(k for k in own if k != 9)] + [sum(weight(units[k], i) * k for k in own if k != 9) for i in range(n)]
    monkeypatch.setattr(rs, "HELD", 50)
    parts = [r for b in rs._row_sums(["g"], {"m": "bigint"}, n, 7)(iter(halves)) for r in b.to_pylist()]
    assert len(parts) == 6
    for group in range(3):
        whole = next(r["w"] for r in out if r["g"] == group)
        assert [sum(x) for x in zip(*(p["w"] for p in parts if p["g"] == group))] == whole


@pytest.mark.parametrize("count", [1, 2, 37, 5000, 4_000_000])
def test_poisson_inverse_is_the_distribution(count):
    low, upto = rs.poisson_inverse(count)
    step = np.diff(np.r_[0.0, upto])
    k = low + np.arange(len(step))
    assert upto[-1] == pytest.approx(1, abs=1e-8)
    assert (k * step).sum() == pytest.approx(count, rel=1e-7) and ((k - count) ** 2 * step).sum() == pytest.approx(count, rel=1e-6)


def test_cell_draws_are_inverted_hashes(table):
    import hashlib

    draws = {(r["a"], r["replicate"]): r["w"] for r in rs.weighted_cells(table, ["setting"], ["a"], n=9, seed=5).collect()}
    for a in (True, False):
        count = table.where(F.col("a") == a).count()
        assert draws[a, -1] == count
        for replicate in range(9):
            h = hashlib.md5(f"5|{replicate // 2}|s|{str(a).lower()}".encode()).hexdigest()
            u, k, p = int(h[16 * (replicate % 2):][:13], 16) / 2**52, 0, 0.0
            while True:
                p += math.exp(k * math.log(count) - count - math.lgamma(k + 1))
                if u < p:
                    break
                k += 1
            assert draws[a, replicate] == k


def test_a_node_whose_cells_agree_is_not_split(table):
    """Draws of the statistic's values alone, and the same draws shared out to the cells below."""
    few = rs.multinomial_cells(table, ["problem_uid", "a"], n=40, of=["a"])
    assert few.columns == ["a", "replicate", "w"] and few.count() == 80
    cells = rs.share_out(table, few, ["problem_uid", "a"], ["a"])
    assert cells.count() == 40 * 600
    assert rows(cells.groupBy("a", "replicate").agg(F.sum("w").alias("w"))) == rows(few)
    assert {r["n"] for r in few.groupBy("replicate").agg(F.sum("w").alias("n")).collect()} == {600}
