"""Published report tables; every rate keeps its count beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import EXECUTIONS, LABELS, NONE, OUTCOME_COLUMNS, SHORT
from ..functions.outcomes import percent, ratio


def coverage_table(df: DataFrame, by=("setting",), label: str = "oracle_label") -> DataFrame:
    """n, four solve percents and oracle coverage."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(OUTCOME_COLUMNS[p])).alias(f"c_{SHORT[p]}") for p in EXECUTIONS],
        F.count_if(F.col(label) != NONE).alias("c_oracle"),
    )
    return counts.select(
        *by, "n", *[percent(f"c_{SHORT[p]}", "n").alias(f"{SHORT[p]}_pct") for p in EXECUTIONS],
        percent("c_oracle", "n").alias("oracle_pct"),
    )


def oracle_distribution(df: DataFrame, by=("setting",), label: str = "oracle_label") -> DataFrame:
    """n and five label percents."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(label) == p).alias(f"c_{SHORT[p]}") for p in LABELS]
    )
    return counts.select(*by, "n", *[percent(f"c_{SHORT[p]}", "n").alias(f"{SHORT[p]}_pct") for p in LABELS])


def label_counts(df: DataFrame, by=("setting",), label: str = "oracle_label") -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n"))


def label_shares(df: DataFrame, by, label: str = "oracle_label") -> DataFrame:
    """Share per label inside each group; shares sum to 1."""
    by = [by] if isinstance(by, str) else list(by)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(label) == p).alias(f"c_{SHORT[p]}") for p in LABELS]
    )
    return counts.select(*by, "n", *[ratio(f"c_{SHORT[p]}", "n").alias(f"{SHORT[p]}_share") for p in LABELS])


def label_composition(df: DataFrame, by, label: str = "oracle_label") -> DataFrame:
    """Long form of :func:`label_shares`: group, label, n, share of its group."""
    by = [by] if isinstance(by, str) else list(by)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(label) == p).alias(p) for p in LABELS]
    )
    long = counts.unpivot([*by, "total"], list(LABELS), "label", "n").where("n > 0")
    return long.select(*by, "label", "n", ratio("n", "total").alias("share"))


def _interaction_cells() -> list[Column]:
    per, bro = F.col("per_correct"), F.col("broadcast_correct")
    return [
        F.count("*").alias("n"),
        F.count_if(per).alias("c_per"), F.count_if(bro).alias("c_bro"),
        F.count_if(per & ~bro).alias("per_only_count"),
        F.count_if(bro & ~per).alias("broadcast_only_count"),
        F.count_if(per & bro).alias("both_count"),
        F.count_if(~per & ~bro).alias("neither_count"),
    ]


def _interaction_rates(by) -> list:
    out = [
        *by, "n",
        percent("c_per", "n").alias("per_solve_pct"),
        percent("c_bro", "n").alias("broadcast_solve_pct"),
        percent(F.col("c_bro") - F.col("c_per"), "n").alias("broadcast_minus_per_points"),
    ]
    for cell in ("per_only", "broadcast_only", "both", "neither"):
        out += [F.col(f"{cell}_count"), percent(f"{cell}_count", "n").alias(f"{cell}_pct")]
    return out


def both_failed() -> Column:
    """The published condition: the two cheap protocols failed.

    It conditions on neither of the compared arms.
    """
    return ~F.col("baseline_correct") & ~F.col("single_correct")


def interaction_table(df: DataFrame, by=("setting",), where: Column | None = None) -> DataFrame:
    """The two dear protocols against each other on a subset; empty groups drop out."""
    by = list(by)
    subset = df.where(both_failed() if where is None else where)
    return subset.groupBy(*by).agg(*_interaction_cells()).select(*_interaction_rates(by))


def interaction_subsets(df: DataFrame, escalated: Column, by=("setting",)) -> DataFrame:
    """The same cells for four subsets; a row is exploded to those it belongs to."""
    by = ["subset", *by]
    member = F.array(
        F.lit("all"),
        F.when(~F.col("baseline_correct"), F.lit("baseline_failed")),
        F.when(both_failed(), F.lit("both_failed")),
        F.when(escalated, F.lit("gate_escalated")),
    )
    rows = df.withColumn("subset", F.explode(F.filter(member, lambda x: x.isNotNull())))
    return rows.groupBy(*by).agg(*_interaction_cells()).select(*_interaction_rates(by))


def source_breakdown(df: DataFrame, k: int = 12, by: str = "source") -> DataFrame:
    """The ``k`` largest sources with their solve rates; name breaks ties."""
    counts = df.groupBy(by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(OUTCOME_COLUMNS[p])).alias(f"c_{SHORT[p]}") for p in EXECUTIONS],
    )
    rates = counts.select(by, "n", *[ratio(f"c_{SHORT[p]}", "n").alias(f"{SHORT[p]}_rate") for p in EXECUTIONS])
    return rates.orderBy(F.desc("n"), by).limit(k)


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """A top-k report: TakeOrderedAndProject, never a full sort."""
    return df.orderBy(*order).limit(k)
