"""Matched outcome tables: construction, labels, validation, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import EXECUTIONS, LABELS, NONE, OUTCOME_COLUMNS, REQUIRED_COLUMNS, SHORT, TOKEN_COLUMNS
from ..functions.outcomes import (
    canonical_protocol,
    oracle_label,
    strict_outcome,
    value_target_columns,
)


class MatchedTableError(ValueError):
    """A table that breaks the matched design."""


def require_columns(df: DataFrame, columns=REQUIRED_COLUMNS, where: str = "table") -> None:
    """Schema check; no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MatchedTableError(f"{where}: missing required columns {missing}")


def matched_outcomes(runs: DataFrame, keys=("setting", "problem_uid")) -> tuple[DataFrame, DataFrame]:
    """Long run log to one row per problem; problems without all four are set aside.

    ``runs`` holds ``protocol`` (any spelling), ``passed`` and optionally
    ``tokens``.  One shuffle on the problem key, partial aggregation before it,
    no pivot job.  Returns ``(matched, incomplete)``.
    """
    protocol = canonical_protocol("protocol")
    has_tokens = "tokens" in runs.columns
    aggs = []
    for p in EXECUTIONS:
        aggs.append(F.max(F.when(F.col("_p") == p, F.col("passed"))).alias(OUTCOME_COLUMNS[p]))
        if has_tokens:
            aggs.append(F.sum(F.when(F.col("_p") == p, F.col("tokens"))).cast("bigint").alias(TOKEN_COLUMNS[p]))
    wide = runs.withColumn("_p", protocol).groupBy(*keys).agg(*aggs)
    present = reduce(lambda a, b: a + b, [F.col(OUTCOME_COLUMNS[p]).isNotNull().cast("int") for p in EXECUTIONS])
    return wide.where(present == 4), wide.where(present < 4).withColumn("n_protocols", present)


def with_oracle_label(df: DataFrame, columns: dict | None = None, parse: bool = False) -> DataFrame:
    """Attach the recomputed ``oracle_label``.

    A stored label is kept as ``oracle_cheapest_successful``; it is never trusted.
    """
    cols = columns or OUTCOME_COLUMNS
    if "oracle_label" in df.columns:
        if "oracle_cheapest_successful" not in df.columns:
            df = df.withColumnRenamed("oracle_label", "oracle_cheapest_successful")
        else:
            df = df.drop("oracle_label")
    if parse:
        df = df.withColumns({cols[p]: strict_outcome(cols[p]) for p in EXECUTIONS})
    return df.withColumn("oracle_label", oracle_label(cols))


def binary_text(col) -> Column:
    """Does a raw cell spell 0, 1, true or false?"""
    return F.coalesce(F.lower(F.trim(F.col(col).cast("string"))).isin("0", "1", "true", "false"), F.lit(False))


def validate_matched(df: DataFrame, source: str | None = None, examples: int = 5) -> DataFrame:
    """Violations as rows ``(check, setting, n_bad, example)``; empty means valid.

    Checks binary cells, unique ids and, with ``source`` (a file or folder
    column), one setting per source.  ``n_bad`` counts every offender and up to
    ``examples`` of them are shown, chosen by a rank limit that Spark applies
    before the shuffle, so a table of nothing but offenders stays bounded.
    """
    offences = F.array(*[
        F.when(~binary_text(c), F.struct(
            F.lit(f"non_binary:{c}").alias("check"), F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias("example")
        )) for c in OUTCOME_COLUMNS.values()
    ])
    cells = (
        df.select("setting", F.explode(F.filter(offences, lambda x: x.isNotNull())).alias("o"))
        .groupBy("o.check", "setting", "o.example").agg(F.count("*").alias("n"))
    )
    dupes = (
        df.groupBy("setting", "problem_uid").agg(F.count("*").alias("n")).where("n > 1")
        .select(F.lit("duplicate_uid").alias("check"), "setting", F.col("problem_uid").cast("string").alias("example"),
                (F.col("n") - 1).alias("n"))
    )
    found = cells.unionByName(dupes)
    if source:
        per_source = df.groupBy(source, "setting").agg(F.count("*").alias("n"))
        mixed = (
            per_source.groupBy(source).agg(F.count("*").alias("n"), F.min("setting").alias("setting")).where("n > 1")
            .select(F.lit("mixed_settings").alias("check"), "setting", F.col(source).alias("example"),
                    F.lit(1).cast("bigint").alias("n"))
        )
        found = found.unionByName(mixed)
    total = found.groupBy("check", "setting").agg(F.sum("n").alias("n_bad"))
    w = Window.partitionBy("check", "setting").orderBy("example")
    shown = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= examples)
    shown = shown.groupBy("check", "setting").agg(F.concat_ws(", ", F.array_sort(F.collect_list("example"))).alias("examples"))
    return total.join(shown, ["check", "setting"]).select("check", "setting", "n_bad", "examples")


def assert_valid(df: DataFrame, source: str | None = None) -> None:
    """Run :func:`validate_matched` and raise on the first violations."""
    bad = validate_matched(df, source).limit(5).collect()
    if bad:
        raise MatchedTableError("; ".join(f"{r['check']} in {r['setting']}: {r['n_bad']} ({r['examples']})" for r in bad))
    if df.isEmpty():
        raise MatchedTableError("table is empty")


def quality_report(df: DataFrame, stored_label: str = "oracle_cheapest_successful", split: str | None = None) -> DataFrame:
    """Published-table checks as ``(check, setting, n_bad)``.

    Outcome cells are raw text.  One pass counts cell-level checks; uniqueness
    and split disjointness come from a second aggregate on the problem key.
    """
    parsed = {OUTCOME_COLUMNS[p]: strict_outcome(OUTCOME_COLUMNS[p], "null") for p in EXECUTIONS}
    label = oracle_label({p: parsed[OUTCOME_COLUMNS[p]] for p in EXECUTIONS})
    checks = {
        "null_outcome": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in parsed]),
        "non_binary_outcome": reduce(lambda a, b: a | b, [F.col(c).isNotNull() & v.isNull() for c, v in parsed.items()]),
        "null_problem_uid": F.col("problem_uid").isNull(),
    }
    if stored_label in df.columns:
        stored = canonical_protocol(stored_label, "null")
        solved = reduce(lambda a, b: a | b, [F.coalesce(v, F.lit(False)) for v in parsed.values()])
        checks["label_mismatch"] = ~stored.eqNullSafe(label)
        checks["none_iff_unsolved"] = F.coalesce(stored == NONE, F.lit(False)) == solved
    names = list(checks)
    cells = df.groupBy("setting").agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    long = cells.unpivot(["setting"], names, "check", "n_bad")

    key_aggs = [F.count("*").alias("rows")]
    if split:
        key_aggs += [F.min(split).alias("lo"), F.max(split).alias("hi")]
    keyed = df.groupBy("setting", "problem_uid").agg(*key_aggs)
    key_checks = [F.count_if(F.col("rows") > 1).alias("duplicate_problem_uid")]
    if split:
        key_checks.append(F.count_if(F.col("lo") != F.col("hi")).alias("split_overlap"))
    per_key = keyed.groupBy("setting").agg(*key_checks)
    long_keys = per_key.unpivot(["setting"], [c for c in per_key.columns if c != "setting"], "check", "n_bad")
    return long.unionByName(long_keys).select("check", "setting", "n_bad")


def oracle_shares(df: DataFrame, by=(), label: str = "oracle_label") -> DataFrame:
    """Percent per label over all five values; 0.0 for absent ones and empty input."""
    by = list(by)
    n = F.count("*")
    cols = [
        F.when(n == 0, F.lit(0.0))
        .otherwise(F.lit(100.0) * F.count_if(F.col(label) == p).cast("double") / n.cast("double"))
        .alias(f"{SHORT[p]}_pct")
        for p in LABELS
    ]
    return df.groupBy(*by).agg(*cols)


def value_targets(df: DataFrame, keep=("setting", "problem_uid")) -> DataFrame:
    """Four targets per problem in long form ``(target, y)``; a narrow explode."""
    pairs = F.array(*[F.struct(F.lit(name).alias("target"), y.alias("y")) for name, y in value_target_columns().items()])
    return df.select(*keep, F.explode(pairs).alias("t")).select(*keep, "t.target", "t.y")


def expect_rows(df: DataFrame, n: int) -> DataFrame:
    """``(expected, loaded, ok)`` for a configured row count."""
    return df.agg(F.count("*").alias("loaded")).select(
        F.lit(n).cast("bigint").alias("expected"), "loaded", (F.col("loaded") == n).alias("ok")
    )
