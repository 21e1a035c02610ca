"""Operators over the setting dimension (ten rows or a caller's own list)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_settings(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Keep listed settings."""
    return df.join(dim.select("setting"), "setting", "left_semi")


def missing_settings(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Listed settings without rows; the data side is reduced before the join."""
    present = df.select("setting").distinct()
    return dim.select("setting").join(present, "setting", "left_anti")


def label_settings(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Display names; an unknown setting shows its endpoint and its raw name."""
    named = df.drop("solver", "setting_label").join(
        dim.select("setting", "solver", "setting_label"), "setting", "left"
    )
    fallback = F.col("model_endpoint") if "model_endpoint" in df.columns else F.col("setting")
    return named.withColumn("solver", F.coalesce("solver", fallback)).withColumn(
        "setting_label", F.coalesce("setting_label", "setting")
    )


def report_order(df: DataFrame, dim: DataFrame, order: str = "coverage_ord") -> DataFrame:
    """Report rows with their position: known settings first, others by name."""
    ranked = df.join(dim.select("setting", F.col(order).alias("_ord")), "setting", "left")
    return ranked.withColumn("report_rank", F.coalesce(F.col("_ord"), F.lit(1_000_000_000)).cast("bigint")).drop(
        "_ord"
    ).orderBy("report_rank", "setting")


def union_settings(frames: list[DataFrame]) -> DataFrame:
    """Stack per-setting tables; extra columns are kept as NULL where absent."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
