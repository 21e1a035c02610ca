"""Exact running totals and ranks without one task per group.

A window over a group that holds a third of all rows is one task.  Here the
order is cut into ranges, each (group, range) gets its own window, and the
totals of the earlier ranges are added as an offset.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def split_points(df: DataFrame, col: str, n: int = 256) -> list[float]:
    """About ``n`` quantiles of a numeric column; the only thing sent to the driver."""
    probs = [i / n for i in range(1, n)]
    values = df.stat.approxQuantile(col, probs, 1.0 / (4 * n))
    return sorted(set(values))


def add_range(df: DataFrame, col: str, points: list[float], out: str = "_range") -> DataFrame:
    """Range number of ``col`` by binary search over the split points."""
    if not points:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *points, float("inf")]
    keyed = df.withColumn("_order_value", F.col(col).cast("double"))
    ranged = Bucketizer(splits=splits, inputCol="_order_value", outputCol=out).transform(keyed)
    return ranged.withColumn(out, F.col(out).cast("int")).drop("_order_value")


def by_ranges(df: DataFrame, by: list[str], order: str, out: str = "_range") -> DataFrame:
    """The rows with the number of their range, from a sort of all rows by group and order; written.

    Spark samples the bounds, so a range is about as long as any other one and a
    group has as many of them as it has rows: nobody needs to know the scores or
    the sizes of groups beforehand.  The numbers are read again and never made
    twice, as another sort could draw other bounds.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*by, order]]).withColumn(out, F.spark_partition_id())
    return written(ranged, "ranges")


def running_totals(df: DataFrame, by: list[str], order: str, cols: list[str], descending: bool = False,
                   points: list[float] | None = None, bounded: bool = False) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over all rows strictly before this one.

    ``order`` must be unique within ``by``.  Totals of ranges (see ``by_ranges``,
    whose result is taken as it is) are added up to offsets, and each range has a
    window of its own.  With split points the ranges are those; ``bounded`` is for
    tables that are known to have a bounded number of rows per group: one window a
    group, and nothing is written.
    """
    key = F.desc(order) if descending else F.asc(order)

    def before(*partition):
        return Window.partitionBy(*partition).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)

    if bounded:
        w = before(*by)
        return df.withColumns({f"cum_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})

    given = [c for c in df.columns if c != "_range"]
    if points is not None:
        ranged = add_range(df, order, points)
    else:
        ranged = df if "_range" in df.columns else by_ranges(df, by, order)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    side = F.desc("_range") if descending else F.asc("_range")
    tw = Window.partitionBy(*by).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(tw), F.lit(0)).alias(f"_o_{c}") for c in cols])
    inner = before(*by, "_range")
    local = ranged.withColumns({f"_w_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in cols})
    conds = [local[k].eqNullSafe(offsets[k]) for k in [*by, "_range"]]
    joined = local.join(offsets, conds)
    return joined.select(*[local[c] for c in given], *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in cols])


def hash_rank(df: DataFrame, by: str, order_hash: str, hex_digits: int = 3) -> DataFrame:
    """Add ``rank`` and ``group_size`` by a hex hash column within ``by``.

    Rows are bucketed by the leading hex digits (uniform whatever the data), so
    a group spreads over ``16 ** hex_digits`` windows; bucket offsets are a
    table of at most groups x buckets rows.
    """
    keyed = df.withColumn("_bucket", F.substring(order_hash, 1, hex_digits))
    totals = keyed.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    offsets = totals.select(
        F.col(by).alias("_by"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(whole).alias("group_size"),
    )
    local = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(order_hash)))
    joined = local.join(offsets, (F.col(by) == F.col("_by")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(*df.columns, (F.col("_rn") + F.col("_offset")).cast("bigint").alias("rank"), "group_size")
