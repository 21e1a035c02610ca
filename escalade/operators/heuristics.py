"""Majority routers: per tier, and over a fallback chain of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import BASELINE, LABELS, literal_map

RANK = {p: i for i, p in enumerate(LABELS)}


def majority_label(df: DataFrame, by=(), label: str = "oracle_label") -> DataFrame:
    """Most frequent label per group; ties go to the cheaper one."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    order = F.struct(F.col("n"), -F.element_at(literal_map(RANK), F.col(label)))
    return counts.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.max_by(label, order).alias("majority"))


class BucketMajority:
    """Majority label over a chain of bucket columns, then the global majority.

    ``fit`` only describes one aggregate over all levels: a row is exploded to its
    (level, value) pairs and combined before the shuffle.  Nothing is collected;
    ``transform`` joins the counted table in the same plan, where the run-time
    sizes decide how.
    """

    def __init__(self, cols: list[str], label: str = "oracle_label"):
        self.cols, self.label = list(cols), label
        self.table: DataFrame | None = None

    def fit(self, df: DataFrame) -> "BucketMajority":
        pairs = F.array(
            *[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("value")) for c in self.cols],
            F.struct(F.lit("*").alias("level"), F.lit("*").alias("value")),
        )
        long = df.select(F.explode(pairs).alias("b"), F.col(self.label).alias("label")).select("b.level", "b.value", "label")
        self.table = majority_label(long.where("value IS NOT NULL"), ["level", "value"], "label").drop("n_rows")
        return self

    def transform(self, df: DataFrame, out: str = "predicted_label") -> DataFrame:
        found = []
        for c in self.cols:
            name = f"_m_{c}"
            side = self.table.where(F.col("level") == c).select(F.col("value").alias(f"_v_{c}"), F.col("majority").alias(name))
            df = df.join(side, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
            found.append(F.col(name))
        overall = self.table.where("level = '*'").agg(F.max("majority")).scalar()
        return df.withColumn(out, F.coalesce(*found, overall, F.lit(BASELINE))).drop(*[f"_m_{c}" for c in self.cols])


class TierMajority(BucketMajority):
    """Majority per difficulty tier; a NULL or unseen tier gets the global majority."""

    def __init__(self, tier: str = "difficulty_tier", label: str = "oracle_label"):
        super().__init__([tier], label)
