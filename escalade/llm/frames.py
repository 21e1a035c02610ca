"""Table helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.session import new_folder, ship_package

__all__ = ["components", "discard", "join_counted", "lean_batches", "pick", "read", "settle", "ship_package"]

#: A key is hot if it has more than this part of all rows, so there are fewer hot keys than this.
HOT_KEYS = 1024
#: Keys that may be broadcast, as text and with their share of a hash table.
KEY_BYTES = 96 << 20
#: Rows of a batch that goes to a Python worker, where whole texts are handled.
BATCH_ROWS = 2000
#: Spark's setting of that.
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables; the package goes to the executors with the first read."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lean_batches(spark: SparkSession) -> None:
    """Give Python workers ``BATCH_ROWS`` rows at a time, if the session gives more.

    A batch stands in memory at once, in the executor and, several times over,
    in a worker that makes strings or arrays of it.
    """
    rows = int(spark.conf.get(BATCH_SETTING))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps survive lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._settled = path
    return table


def join_counted(rows: DataFrame, table: DataFrame, on: str | list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row per key and counts in ``n`` the rows of that key.

    Hot keys, of which there are fewer than ``HOT_KEYS`` whatever the data, are
    joined by broadcast, so their rows stay where they are; no other key has
    more than 1/HOT_KEYS of the rows.  Both tables should be settled, as both
    are read twice; rows of ``table`` should be short.  ``n`` is left out of the result.
    """
    on = [on] if isinstance(on, str) else list(on)
    limit = (table.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS
    hot = table.where(F.col(n) > limit).drop(n)
    spread = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col(n) <= limit).drop(n), on, how)
    return spread.unionByName(rest)


def pick(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``rows`` of the written table ``keys`` (short rows, each key once), joined by broadcast while all keys are measured to fit.

    Long rows then stay where they are, instead of being shuffled to be thrown
    away; beyond ``KEY_BYTES`` both sides are shuffled.
    """
    size = keys.agg(F.sum(F.octet_length(F.col(on).cast("string")) + 24 * len(keys.columns))).first()[0] or 0
    return rows.join(F.broadcast(keys) if size <= KEY_BYTES else keys, on, how)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): the smallest node that each node reaches.

    Large-star and small-star rounds in turn: every node hangs its greater
    neighbours, then its smaller ones, on the least of them, until nothing
    changes.  The rounds grow with the logarithm of the longest path; each one
    is grouping by minimum, which combines map-side, and an equi-join with the
    written minima, whose hot partitions AQE can split, as both sides come
    straight from a shuffle.  A round's tables go when the next ones are written.
    """
    edges = settle(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        lower = settle(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = settle(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _mark(stars)
        discard(edges, least, large, lower)
        edges = stars
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._settled)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
