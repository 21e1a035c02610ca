"""Row filters with their accounting, and leakage checks on rows and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import truthy
from ..functions.text import strip

# Phrases that point at a missing figure or table.
ARTIFACT_PHRASES = (
    "as shown in the figure",
    "from the image",
    "see figure",
    "shown in the diagram",
    "in the table below",
)

# Metadata keys that give the outcome away.
FORBIDDEN_METADATA = (
    "baseline_correct",
    "single_correct",
    "per_correct",
    "broadcast_correct",
    "oracle_cheapest_successful",
    "any_protocol_solved",
    "gold_answer",
    "answer_key",
    "correct_answer",
    "protocol_outcomes",
)


def filter_tagged(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose tag cell is truthy."""
    return df.where(~truthy(col))


def split_missing_artifact(df: DataFrame, text: str, phrases=ARTIFACT_PHRASES) -> tuple[DataFrame, DataFrame]:
    """``(kept, excluded)``; excluded rows carry the phrases found as ``reasons``."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    reasons = F.filter(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())
    tagged = df.withColumn("reasons", reasons)
    return tagged.where(F.size("reasons") == 0).drop("reasons"), tagged.where(F.size("reasons") > 0)


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """Keep named subsets; the predicate reaches the file scan."""
    return df.where(F.col(col).isin(*values))


def limit_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """First ``n`` rows in an explicit order (a top-n, never a full sort)."""
    return df.orderBy(order).limit(n)


def row_leakage(df: DataFrame) -> DataFrame:
    """Per problem: forbidden metadata keys (fail) and the answer inside the prompt (warning).

    Expects ``input``, ``answer`` and a ``metadata`` map.
    """
    forbidden = F.array(*[F.lit(k) for k in FORBIDDEN_METADATA])
    leaked = F.array_sort(F.array_intersect(F.map_keys("metadata"), forbidden))
    answer = strip(F.coalesce("answer", F.lit("")))
    inside = (F.length(answer) >= 3) & F.coalesce(F.col("input"), F.lit("")).contains(answer)
    return df.withColumn("leaked_keys", F.coalesce(leaked, F.array().cast("array<string>"))).withColumn(
        "hard_fail", F.size("leaked_keys") > 0
    ).withColumn("answer_in_prompt", inside)


def value_leakage(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Does a feature, by value, reproduce the label?

    ``purity`` is the share of rows that the majority label of their value
    explains; ``base_rate`` is the same without the feature.  Three partial
    aggregates, nothing collected per value.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    counts = (
        df.select(F.explode(pairs).alias("p"), F.col(label).alias("label"))
        .groupBy("p.feature", "p.value", "label").agg(F.count("*").alias("n"))
    )
    values = counts.groupBy("feature", "value").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    purity = values.groupBy("feature").agg(
        F.count("*").alias("n_values"), F.sum("n").alias("n_rows"), F.sum("top").alias("explained")
    )
    base = counts.groupBy("feature", "label").agg(F.sum("n").alias("n")).groupBy("feature").agg(
        F.max("n").alias("majority")
    )
    joined = purity.join(base, "feature")
    n = F.col("n_rows").cast("double")
    return joined.select(
        "feature", "n_values", "n_rows",
        (F.col("explained") / n).alias("purity"),
        (F.col("majority") / n).alias("base_rate"),
    )
