"""The published tables from a matched table, rounded and in report order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import setting_dim
from ..functions.text import fixed, format_ci
from ..operators.reports import coverage_table, interaction_table, oracle_distribution
from ..operators.resample import interaction_ci
from ..operators.settings import label_settings, report_order


def _published(table: DataFrame, labelled: DataFrame, dim: DataFrame, order: str, decimals: int) -> DataFrame:
    if "model_endpoint" in labelled.columns:
        endpoints = labelled.groupBy("setting").agg(F.min("model_endpoint").alias("model_endpoint"))
        table = table.join(endpoints, "setting", "left")
    named = report_order(label_settings(table, dim), dim, order)
    cols = [
        fixed(c, decimals).cast("double").alias(c) if t == "double" else F.col(c)
        for c, t in named.dtypes if c not in ("setting", "solver", "setting_label", "model_endpoint", "report_rank")
    ]
    return named.select("solver", F.col("setting_label").alias("setting"), *cols)


def published_tables(labelled: DataFrame, dim: DataFrame | None = None, resamples: int = 2000, seed: int = 42) -> dict[str, DataFrame]:
    """``matched_protocol_coverage``, ``oracle_label_distribution`` and ``per_broadcast_interaction``."""
    dim = dim if dim is not None else setting_dim(labelled.sparkSession)
    cross = interaction_table(labelled)
    bounds = interaction_ci(labelled, n=resamples, seed=seed).select(
        "setting", format_ci("ci_low", "ci_high", 1).alias("broadcast_minus_per_ci_points")
    )
    return {
        "matched_protocol_coverage": _published(coverage_table(labelled), labelled, dim, "coverage_ord", 2),
        "oracle_label_distribution": _published(oracle_distribution(labelled), labelled, dim, "oracle_ord", 2),
        "per_broadcast_interaction": _published(cross.join(bounds, "setting", "left"), labelled, dim, "oracle_ord", 1),
    }
