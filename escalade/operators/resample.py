"""Problem-level percentile bootstrap.

The resampling unit is the problem, so the intervals speak of problem sampling
and not of run-to-run variation.  Every interval is computed from *weighted
cells*: one row per (group, replicate, cell) with the resample weight of the
cell.  There are two ways to get them.

``cells`` (default)  Rows are counted per cell first.  The weight of a cell with
    c problems is Poisson(c), the sum of c independent Poisson(1) weights, so
    the cost is replicates x cells whatever the number of rows.  A draw inverts
    the distribution at 52 bits of a hash of (seed, replicate, cell).
``rows``  Each problem gets its own Poisson(1) weight from a hash of (seed,
    replicate, id): needed when the statistic sums a per-row measure such as
    tokens.  One hash serves four replicates.  A task keeps one array of all
    replicates' sums per group and adds its rows up in it, so a task hands on one
    row per group, and never a row per problem and replicate.

Both kinds of draws can be repeated outside Spark, and none depends on
partitioning or on a retry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from ..functions.outcomes import escalation_direction, ratio
from .calibration import auroc_from_table, ece_from_table
from .replay import confusion_counts, macro_f1_from_counts

LANES = 4
DRAWS = 100
UNIT = float(2**32)
# Children of a node of the multinomial tree: one byte of the digest.
FAN_OUT = 256
# Rows that are weighted at once, and numbers that a task holds before it hands groups on.
PORTION = 256
HELD = 1 << 23


def poisson_thresholds() -> list[float]:
    """Cumulative Poisson(1) probabilities that 32 uniform bits can tell apart."""
    out, term, total, k = [], math.exp(-1.0), 0.0, 0
    while True:
        total += term
        if total * UNIT >= UNIT - 1:
            return out
        out.append(total)
        k += 1
        term /= k


def _lane_bits(seeded: list, unit: bytes) -> bytes:
    """The hashes of one unit in all blocks, four lanes of 32 bits each."""
    out = []
    for start in seeded:
        own = start.copy()
        own.update(unit)
        out.append(own.digest())
    return b"".join(out)


def _row_sums(keys: list[str], kinds: dict[str, str], n: int, seed: int):
    """Rows to one row per group: the group's columns, and arrays of the sample's sum and all replicates' sums."""
    blocks = (n + LANES - 1) // LANES
    edges = np.array([math.ceil(t * UNIT) for t in poisson_thresholds()], dtype=np.uint64)
    measures = list(kinds)
    types = {m: np.int64 if kinds[m] == "bigint" else np.float64 for m in measures}

    def told(held: dict) -> pa.RecordBatch:
        first = [h[0] for h in held.values()]
        rows = {c: pa.concat_arrays([f.column(c) for f in first]) for c in keys}
        sums = {"w": pa.array([h[1] for h in held.values()], pa.list_(pa.int64()))}
        sums |= {m: pa.array([h[2][m] for h in held.values()], pa.list_(pa.int64() if kinds[m] == "bigint" else pa.float64())) for m in measures}
        return pa.RecordBatch.from_pydict(rows | sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeded = [hashlib.md5(f"{seed}|{block}|".encode()) for block in range(blocks)]
        held: dict[tuple, tuple] = {}
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            units = batch.column("_unit").to_pylist()
            values = {m: batch.column(m).fill_null(0).to_numpy(zero_copy_only=False).astype(types[m]) for m in measures}
            members: dict[tuple, list[int]] = {}
            for k, name in enumerate(names):
                members.setdefault(name, []).append(k)
            for name, rows in members.items():
                if name not in held:
                    held[name] = (batch.select(keys).slice(rows[0], 1), np.zeros(n + 1, np.int64), {m: np.zeros(n + 1, types[m]) for m in measures})
                _, total, sums = held[name]
                for begin in range(0, len(rows), PORTION):
                    part = rows[begin:begin + PORTION]
                    bits = np.frombuffer(b"".join(_lane_bits(seeded, (units[k] or "").encode()) for k in part), dtype=">u4")
                    weight = np.searchsorted(edges, bits.astype(np.uint64), side="right").reshape(len(part), -1)[:, :n]
                    total[0] += len(part)
                    total[1:] += weight.sum(axis=0)
                    for m in measures:
                        own = values[m][part]
                        sums[m][0] += own.sum()
                        sums[m][1:] += (weight * own[:, None]).sum(axis=0)
            if len(held) * (n + 1) * (1 + len(measures)) > HELD:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    return run


def _added(keys: list[str], kinds: dict[str, str]):
    """Adds up the arrays of neighbouring rows of one group."""
    names = ["w", *kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, schema = None, None, None
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            arrays = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in names}
            schema = batch.schema
            for k, group in enumerate(groups):
                row = [arrays[c][1][arrays[c][0][k]:arrays[c][0][k + 1]] for c in names]
                if own is not None and group == own[0]:
                    sums = [a + b for a, b in zip(sums, row)]
                    continue
                if own is not None:
                    yield _one(own[1], sums, schema)
                own, sums = (group, batch.select(keys).slice(k, 1)), row
        if own is not None:
            yield _one(own[1], sums, schema)

    def _one(first: pa.RecordBatch, sums: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(first.columns) + [pa.array([s], schema.field(c).type) for c, s in zip(names, sums)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *names])

    return run


def _row_weighted(df: DataFrame, by, cell, unit: str, n: int, seed: int, measures) -> DataFrame:
    keys = [*by, *cell]
    narrow = df.select(*keys, *[F.col(m).cast("bigint" if dict(df.dtypes)[m] in ("tinyint", "smallint", "int", "bigint") else "double") for m in measures],
                       F.coalesce(F.col(unit).cast("string"), F.lit("")).alias("_unit"))
    kinds = {m: dict(narrow.dtypes)[m] for m in measures}
    schema = ", ".join([f"`{c}` {dict(narrow.dtypes)[c]}" for c in keys] + ["w array<bigint>"] + [f"`{m}` array<{k}>" for m, k in kinds.items()])
    # Hashing costs far more than moving a row: deal the rows out evenly first, whatever the partitions of the input are.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = narrow.repartition(tasks).mapInArrow(_row_sums(keys, kinds, n, seed), schema)
    gathered = sums.repartition(tasks, *keys).sortWithinPartitions(*keys) if keys else sums.coalesce(1)
    total = gathered.mapInArrow(_added(keys, kinds), schema)
    each = F.transform("w", lambda w, i: F.struct(
        (i - 1).cast("int").alias("replicate"), w.alias("w"), *[F.get(F.col(m), i).alias(f"w_{m}") for m in measures]
    ))
    return total.select(*keys, F.explode(each).alias("_l")).select(*keys, "_l.*")


@lru_cache(maxsize=64)
def poisson_inverse(count: int) -> tuple[int, np.ndarray]:
    """The least value of a table, and the probability of no more than each value from there on.

    The table ends where probabilities no longer reach the 52 bits of a draw, on both sides.
    """
    middle = int(count)
    spread = 12 * math.sqrt(count) + 40
    low, high = max(0, int(middle - spread)), int(middle + spread)
    k = np.arange(low, high + 1, dtype=float)
    steps = np.where(k > low, math.log(count) - np.log(np.maximum(k, 1.0)), 0.0)
    steps[0] = low * math.log(count) - count - math.lgamma(low + 1)
    return low, np.cumsum(np.exp(np.cumsum(steps)))


def _cell_key(columns) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]) if columns else F.lit("")


def _cell_weighted(df: DataFrame, by, cell, n: int, seed: int) -> DataFrame:
    counts = df.groupBy(*by, *cell).agg(F.count("*").alias("_count"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.sequence(F.lit(0), F.lit((n + DRAWS - 1) // DRAWS - 1))
    drawn = counts.withColumn("_block", F.explode(blocks)).repartition(tasks, *by, *cell, "_block")

    @pandas_udf(ArrayType(LongType()))
    def draw(count: pd.Series, key: pd.Series, block: pd.Series) -> pd.Series:
        """One hash serves two replicates, whatever batch or task they fall into."""
        out = []
        for c, name, b in zip(count, key, block):
            hashes = b"".join(hashlib.md5(f"{seed}|{pair}|{name}".encode()).digest() for pair in range(b * DRAWS // 2, (b + 1) * DRAWS // 2))
            part = np.frombuffer(hashes, dtype=">u8").astype(np.uint64) >> np.uint64(12)
            low, upto = poisson_inverse(int(c))
            out.append(low + np.searchsorted(upto, part / float(1 << 52), side="right"))
        return pd.Series(out)

    first = F.col("_block") == 0
    weights = F.when(first, F.concat(F.array("_count"), F.col("_w"))).otherwise(F.col("_w"))
    long = drawn.withColumn("_w", draw("_count", _cell_key([*by, *cell]), "_block")).select(*by, *cell, "_block", F.posexplode(weights).alias("_i", "w"))
    replicate = (F.col("_block") * DRAWS + F.col("_i") - (F.col("_block") == 0).cast("int")).cast("int")
    return long.select(*by, *cell, replicate.alias("replicate"), "w").where(F.col("replicate") < n)


def weighted_cells(df: DataFrame, by=(), cell=(), n: int = 2000, seed: int = 42, mode: str = "cells",
                   unit: str = "problem_uid", measures=()) -> DataFrame:
    """``(by..., cell..., replicate, w[, w_<measure>...])`` for ``n`` replicates.

    Replicate -1 is the sample itself (each row once), so the point estimate
    comes out of the same pass.
    """
    by, cell, measures = list(by), list(cell), list(measures)
    if mode == "rows":
        return _row_weighted(df, by, cell, unit, n, seed, measures)
    if measures:
        raise ValueError("per-row measures need mode='rows'")
    return _cell_weighted(df, by, cell, n, seed)


def _node(level: int) -> Column:
    """The tree node of a cell: the first ``level`` bytes of its digest."""
    return F.substring("_digest", 1, 2 * level)


def multinomial_cells(df: DataFrame, cell=(), n: int = 2000, seed: int = 42, of=None) -> DataFrame:
    """Exact draws of as many problems as there are, with replacement, over cells.

    A multinomial draw is split down a tree: a node's draws are shared out among
    its children by their counts, and so on to the cells.  The upper part of the
    tree tells cells apart by the columns ``of`` that a statistic reads (all of
    them if not given).  Below it all cells of a node agree in the statistic, so
    the node is split no further: (``of``..., replicate, w) come out, and neither
    the draws nor their sums cost more than the distinct values.  The draws of
    ``share_out`` go on from there to the cells.

    A node is a prefix of the digests, one byte a level, and the levels follow
    their number, so a node has a few hundred children whatever the size.  Each
    (replicate, node) has a generator of its own.  Every replicate adds up to
    the number of rows.
    """
    of = list(cell if of is None else of)
    counts = df.groupBy(*of).agg(F.count("*").alias("_count"))
    total = counts.agg(F.sum("_count").alias("w")).where("w > 0")
    draws = total.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"), "w", F.lit("").alias("_node"))
    return _split_down(draws, counts, of, [], seed)


def share_out(df: DataFrame, draws: DataFrame, cell, of, seed: int = 42) -> DataFrame:
    """Draws of ``multinomial_cells(..., of=of)`` shared out among the cells (which name the columns ``of`` too) below them."""
    cell, of = list(cell), list(of)
    counts = df.groupBy(*cell).agg(F.count("*").alias("_count"))
    return _split_down(draws.withColumn("_node", _digest(of)), counts, cell, of, seed)


def _digest(columns) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.md5(F.concat_ws("\x1f", F.lit(""), *parts))


def _split_down(draws: DataFrame, counts: DataFrame, cell: list[str], above: list[str], seed: int) -> DataFrame:
    """``draws``: (replicate, w, _node) of the nodes above, named by the digest of ``above`` or '' for all cells."""
    root = _digest(above) if above else F.lit("")
    rest = [c for c in cell if c not in above]
    keyed = counts.withColumn("_digest", _digest(rest)).withColumn("_root", root)
    levels = max(1, math.ceil(math.log(max(1, counts.count()), FAN_OUT)))

    @pandas_udf(ArrayType(LongType()))
    def share(total: pd.Series, sizes: pd.Series, stream: pd.Series) -> pd.Series:
        out = []
        for t, own, s in zip(total, sizes, stream):
            own = np.asarray(own, dtype="int64")
            out.append(np.random.Generator(np.random.Philox(key=int(s) & (2**64 - 1))).multinomial(int(t), own / own.sum()))
        return pd.Series(out)

    def split(draws: DataFrame, children: DataFrame) -> DataFrame:
        """``children``: _node and a list of (child, _count) in a fixed order."""
        joined = draws.select("replicate", "w", "_node").join(children, "_node")
        stream = F.xxhash64(F.lit(seed), F.col("replicate"), F.col("_node"))
        taken = joined.withColumn("_taken", share("w", F.transform("_children", lambda c: c["_count"]), stream))
        pairs = F.arrays_zip(F.transform("_children", lambda c: c["child"]).alias("child"), F.col("_taken").alias("w"))
        return taken.select("replicate", F.explode(pairs).alias("_p")).select("replicate", "_p.child", "_p.w")

    def node(level: int) -> Column:
        return F.concat("_root", _node(level)) if level else F.col("_root")

    for level in range(1, levels):
        sums = keyed.groupBy(node(level - 1).alias("_node"), node(level).alias("child")).agg(F.sum("_count").alias("_count"))
        children = sums.groupBy("_node").agg(F.array_sort(F.collect_list(F.struct("child", "_count"))).alias("_children"))
        draws = split(draws, children).withColumnRenamed("child", "_node")
    leaf = F.struct(F.struct("_digest", *cell).alias("child"), "_count")
    cells = keyed.groupBy(node(levels - 1).alias("_node")).agg(F.array_sort(F.collect_list(leaf)).alias("_children"))
    return split(draws, cells).select(*[F.col(f"child.{c}").alias(c) for c in cell], F.col("replicate").cast("int"), "w")


# --- intervals --------------------------------------------------------------


def interval(draws: DataFrame, value: str, by=(), alpha: float = 0.05, keep=()) -> DataFrame:
    """``point, ci_low, ci_high`` of a statistic per replicate.

    The point is replicate -1; the bounds interpolate linearly over the finite
    draws and are NULL without any.  ``keep`` names columns taken from the point.
    """
    v = F.col(value).cast("double")
    own = F.col("replicate") == -1
    finite = F.when(~own & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    return draws.groupBy(*by).agg(
        *[F.max(F.when(own, F.col(c))).alias(c) for c in keep], F.max(F.when(own, v)).alias("point"),
        F.percentile(finite, F.lit(alpha / 2)).alias("ci_low"), F.percentile(finite, F.lit(1 - alpha / 2)).alias("ci_high"),
    )


def bootstrap_ci(df: DataFrame, value: str, by=(), n: int = 2000, seed: int = 42, alpha: float = 0.05,
                 mode: str = "cells", unit: str = "problem_uid") -> DataFrame:
    """Point estimate and interval of the mean of a boolean column."""
    by = list(by)
    w = F.col("w")
    draws = weighted_cells(df, by, [value], n, seed, mode, unit).groupBy(*by, "replicate").agg(
        F.sum(w).alias("n"), ratio(F.sum(F.when(F.col(value), w).otherwise(0)), F.sum(w)).alias("draw")
    )
    return interval(draws, "draw", by, alpha, ["n"])


def bootstrap_metrics(df: DataFrame, metrics: dict[str, tuple[Column, Column]], cell: list[str], by=(), n: int = 2000,
                      seed: int = 42, alpha: float = 0.05, mode: str = "cells", unit: str = "problem_uid",
                      measures=()) -> DataFrame:
    """Many ratio metrics on the same resample: ``(by..., metric, point, ci_low, ci_high)``.

    A metric is ``(numerator, denominator)``, each an expression over the cell
    columns that is summed with the resample weight; measures are referred to
    as ``w_<measure>`` and enter already weighted.
    """
    by = list(by)
    aggs = []
    for i, (num, den) in enumerate(metrics.values()):
        aggs += [F.sum(num).alias(f"n{i}"), F.sum(den).alias(f"d{i}")]
    sums = weighted_cells(df, by, cell, n, seed, mode, unit, measures).groupBy(*by, "replicate").agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), ratio(f"n{i}", f"d{i}").alias("value")) for i, name in enumerate(metrics)
    ])
    draws = sums.select(*by, "replicate", F.explode(rows).alias("m")).select(*by, "replicate", "m.metric", "m.value")
    return interval(draws, "value", [*by, "metric"], alpha)


def misaligned(a: DataFrame, b: DataFrame, key: str = "problem_uid") -> DataFrame:
    """Keys present in only one arm of a paired comparison."""
    left, right = a.select(key, F.lit(True).alias("_a")), b.select(key, F.lit(True).alias("_b"))
    return left.join(right, key, "full_outer").where("_a IS NULL OR _b IS NULL").select(key)


def paired_difference(df: DataFrame, a: str, b: str, by=(), n: int = 2000, seed: int = 42, alpha: float = 0.05,
                      mode: str = "cells", unit: str = "problem_uid", scale: float = 1.0) -> DataFrame:
    """``mean(a) - mean(b)`` of two arms held on the same row, so one weight serves both.

    Arms are booleans or numbers.  Numbers that differ from row to row make as
    many cells as there are differences, so they take the weights of rows.  A
    missing arm is an error; use :func:`misaligned` before joining two tables.
    """
    by = list(by)
    kinds = {dict(df.dtypes)[c] for c in (a, b)}
    step_type = "int" if kinds == {"boolean"} else "double"
    bad = F.raise_error(F.lit("paired arms must align: an arm is missing")).cast(step_type)
    rows = df.withColumn("_d", F.coalesce(F.col(a).cast(step_type) - F.col(b).cast(step_type), bad))
    w = F.col("w")
    if step_type == "int":
        weighted, total = weighted_cells(rows, by, ["_d"], n, seed, mode, unit), F.sum(w * F.col("_d"))
    else:
        weighted, total = weighted_cells(rows, by, [], n, seed, "rows", unit, ["_d"]), F.sum("w__d")
    draws = weighted.groupBy(*by, "replicate").agg(
        F.sum(w).alias("n"), (F.lit(float(scale)) * ratio(total, F.sum(w))).alias("draw")
    )
    return interval(draws, "draw", by, alpha, ["n"])


def mean_ci(df: DataFrame, value: str, by=(), n: int = 2000, seed: int = 42, alpha: float = 0.05, unit: str = "problem_uid") -> DataFrame:
    """Point estimate and interval of the mean of a numeric column; NULLs are left out."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    draws = weighted_cells(rows, by, [], n, seed, "rows", unit, ["_v"]).groupBy(*by, "replicate").agg(
        F.sum("w").alias("n"), ratio(F.sum("w__v"), F.sum("w")).alias("draw")
    )
    return interval(draws, "draw", by, alpha, ["n"])


def _score_ci(df: DataFrame, figure, column: str, by, n, seed, alpha, mode, unit, confidence, correct, risk: bool) -> DataFrame:
    by = list(by)
    usable = df.where(F.col(confidence).isNotNull()).select(
        *by, unit, F.col(confidence).alias("_c"), F.col(correct).alias("_ok")
    )
    c, w = F.col("_c"), F.col("w")
    score = (F.lit(100.0) - c) / F.lit(100.0) if risk else c / F.lit(100.0)
    positive = ~F.col("_ok") if risk else F.col("_ok")
    table = weighted_cells(usable, by, ["_c", "_ok"], n, seed, mode, unit).groupBy(*by, "replicate", score.alias("score")).agg(
        F.sum(F.when(positive, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(positive, 0).otherwise(w)).cast("bigint").alias("neg"),
    )
    return interval(figure(table, [*by, "replicate"]), column, by, alpha)


def auroc_ci(df: DataFrame, by=("setting",), n: int = 2000, seed: int = 42, alpha: float = 0.05, mode: str = "cells",
             unit: str = "problem_uid", confidence: str = "confidence", correct: str = "baseline_correct") -> DataFrame:
    """Failure AUROC on parseable rows with its interval."""
    # A replicate's score table has a row per cell at most.
    return _score_ci(df, partial(auroc_from_table, bounded=True), "auroc", by, n, seed, alpha, mode, unit, confidence, correct, True)


def ece_ci(df: DataFrame, by=("setting",), n: int = 2000, seed: int = 42, alpha: float = 0.05, mode: str = "cells",
           unit: str = "problem_uid", confidence: str = "confidence", correct: str = "baseline_correct") -> DataFrame:
    """Calibration error on parseable rows with its interval."""
    return _score_ci(df, ece_from_table, "ece", by, n, seed, alpha, mode, unit, confidence, correct, False)


def interaction_ci(df: DataFrame, by=("setting",), **options) -> DataFrame:
    """Broadcast minus PER in points where both cheap protocols failed."""
    subset = df.where(~F.col("baseline_correct") & ~F.col("single_correct"))
    return paired_difference(subset, "broadcast_correct", "per_correct", by, scale=100.0, **options)


def router_delta_ci(df: DataFrame, pairs: dict[str, tuple[str, str]], by=("setting",), **options) -> DataFrame:
    """Paired differences in points for several pairs of success columns on the same rows."""
    arms = F.array(*[
        F.struct(F.lit(name).alias("pair"), F.col(a).alias("arm_a"), F.col(b).alias("arm_b")) for name, (a, b) in pairs.items()
    ])
    rows = df.withColumn("_p", F.explode(arms)).select(*df.columns, "_p.*")
    return paired_difference(rows, "arm_a", "arm_b", [*by, "pair"], scale=100.0, **options)


def routing_ci(replayed: DataFrame, by=("setting",), n: int = 2000, seed: int = 42, alpha: float = 0.05,
               mode: str = "cells", unit: str = "problem_uid") -> DataFrame:
    """All routing metrics on the same resample; cells are (gold, pred, success)."""
    by = list(by)
    cell = ["oracle_label", "predicted_label", "success"]
    g, p, w = F.col("oracle_label"), F.col("predicted_label"), F.col("w")

    def total(cond):
        return F.sum(F.when(cond, w).otherwise(0))

    d = escalation_direction(p, g)
    solvable = g != "none"
    sums = weighted_cells(replayed, by, cell, n, seed, mode, unit).groupBy(*by, "replicate").agg(
        F.sum(w).alias("n"), total(F.col("success")).alias("n_success"), total(g == p).alias("n_mode"),
        total(solvable).alias("n_solvable"), total(solvable & ~F.col("success")).alias("n_missed"),
        *[total(d == k).alias(f"n_{k}") for k in ("over", "under", "match")],
        *confusion_counts("oracle_label", "predicted_label", "w"),
    )
    values = {
        "solve_rate": ratio("n_success", "n"),
        "mode_accuracy": ratio("n_mode", "n"),
        "macro_f1": F.when(F.col("n") > 0, macro_f1_from_counts()),
        "missed_success_rate": F.when(F.col("n") > 0, F.coalesce(ratio("n_missed", "n_solvable"), F.lit(0.0))),
        "over_escalation_rate": ratio("n_over", "n"),
        "under_escalation_rate": ratio("n_under", "n"),
        "match_rate": ratio("n_match", "n"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])
    draws = sums.select(*by, "replicate", F.explode(rows).alias("m")).select(*by, "replicate", "m.metric", "m.value")
    return interval(draws, "value", [*by, "metric"], alpha)
