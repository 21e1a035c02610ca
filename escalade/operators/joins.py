"""Joins between runs: predictions, splits, crosswalks, text reconciliation, diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcomes import ratio
from ..functions.text import text_key


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that would fan a join out, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def join_predictions(matched: DataFrame, preds: DataFrame, keys=("problem_uid",), pred: str = "predicted_label",
                     check: bool = True) -> DataFrame:
    """Attach predictions to outcomes by equi-join.

    With ``check``, duplicate prediction keys and an empty result are errors.
    """
    keys = list(keys)
    if check:
        dup = duplicate_keys(preds, keys).limit(5).collect()
        if dup:
            raise ValueError(f"prediction keys are not unique: {[tuple(r) for r in dup]}")
    joined = matched.join(preds.select(*keys, pred), keys, "inner")
    if check and joined.isEmpty():
        raise ValueError(f"no rows joined on {keys}")
    return joined


def unjoined(preds: DataFrame, matched: DataFrame, keys=("problem_uid",)) -> DataFrame:
    """Predictions that match no outcome row."""
    return preds.join(matched.select(*keys), list(keys), "left_anti")


def join_split(df: DataFrame, split: DataFrame, keys=("problem_uid",)) -> DataFrame:
    return df.join(split.select(*keys, "split"), list(keys), "inner")


def crosswalk_join(a: DataFrame, b: DataFrame, xwalk: DataFrame, a_key: str = "uid_a", b_key: str = "uid_b") -> DataFrame:
    """Two runs with different ids, joined through ``(uid_a, uid_b, example_id)``."""
    return a.join(xwalk, a_key, "inner").join(b, b_key, "inner")


def crosswalk_coverage(a: DataFrame, b: DataFrame, xwalk: DataFrame, by: str = "setting",
                       a_key: str = "uid_a", b_key: str = "uid_b") -> DataFrame:
    """Per group: rows of ``a``, rows that reach ``b`` through the crosswalk, and raw-id matches.

    The raw match count shows what a join on the unconverted id would have
    silently kept.
    """
    mapped = a.join(xwalk.select(a_key, b_key), a_key, "left")
    b_ids = b.select(F.col(b_key), F.lit(True).alias("_hit"))
    raw_ids = b.select(F.col(b_key).alias(a_key), F.lit(True).alias("_raw"))
    out = mapped.join(b_ids, b_key, "left").join(raw_ids, a_key, "left")
    return out.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count("_hit").alias("n_matched"),
        F.count("_raw").alias("n_raw_matched"),
    ).withColumn("coverage", ratio("n_matched", "n"))


def reconcile(a: DataFrame, b: DataFrame, text: str, uid: str, cols: list[str]) -> DataFrame:
    """Compare two scorings of the same problems by normalized text.

    One row per text: unique texts compare pairwise, duplicated texts as
    multisets.  The multisets are compared through counts per value tuple, so a
    text shared by any number of rows is never gathered; both aggregates
    combine before their shuffle.
    """
    def side(df, flag):
        return df.select(
            text_key(text).alias("text_key"), F.lit(flag).alias("_in_a"), F.col(uid).cast("string").alias("_uid"),
            F.struct(*[F.col(c) for c in cols]).alias("_v"),
        )

    rows = side(a, True).unionByName(side(b, False))
    cells = rows.groupBy("text_key", "_v").agg(
        F.count_if("_in_a").alias("n_a"),
        F.count_if(~F.col("_in_a")).alias("n_b"),
        F.min(F.when(F.col("_in_a"), F.col("_uid"))).alias("uid_a"),
        F.min(F.when(~F.col("_in_a"), F.col("_uid"))).alias("uid_b"),
    )
    groups = cells.groupBy("text_key").agg(
        F.sum("n_a").alias("n_a"),
        F.sum("n_b").alias("n_b"),
        F.max(F.col("n_a") != F.col("n_b")).alias("differs"),
        F.min("uid_a").alias("uid_a"),
        F.min("uid_b").alias("uid_b"),
        F.min(F.when(F.col("n_a") > 0, F.col("_v"))).alias("a"),
        F.min(F.when(F.col("n_b") > 0, F.col("_v"))).alias("b"),
    )
    pair = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    status = (
        F.when(F.col("n_b") == 0, "only_a")
        .when(F.col("n_a") == 0, "only_b")
        .when(pair & F.col("differs"), "pair_differs")
        .when(pair, "pair_agrees")
        .when(F.col("differs"), "group_differs")
        .otherwise("group_agrees")
    )
    shown = [F.when(pair, F.col(f"{s}.{c}")).alias(f"{c}_{s}") for c in cols for s in ("a", "b")]
    return groups.select(
        "text_key", status.alias("status"), "n_a", "n_b",
        F.when(pair, F.col("uid_a")).alias("uid_a"), F.when(pair, F.col("uid_b")).alias("uid_b"), *shown,
    )


def drop_ambiguous(df: DataFrame, key) -> DataFrame:
    """Rows whose key is unique.

    Any value of a one-row group is that row, so no window gathers the
    duplicates, and columns need no order (maps are allowed).
    """
    named = (F.col(key) if isinstance(key, str) else key).alias("_key")
    grouped = df.groupBy(named).agg(F.count("*").alias("_n"), F.any_value(F.struct(*[F.col(c) for c in df.columns])).alias("_row"))
    return grouped.where("_n = 1").select("_row.*")


def table_diff(produced: DataFrame, reference: DataFrame, keys: list[str], tol: float = 0.0) -> DataFrame:
    """Cells that differ beyond ``tol``, keys with unequal numbers of rows, and missing columns.

    Output ``(keys..., column, produced, reference)``; empty means equal.  The
    column ``<row>`` gives the numbers of rows of a key where they differ; cells
    are compared where both sides have one row.
    """
    value_cols = [c for c in reference.columns if c not in keys]
    missing = [c for c in value_cols if c not in produced.columns]
    shared = [c for c in value_cols if c in produced.columns]

    def single(df, name):
        cells = F.struct(F.lit(0).alias("_"), *[F.col(c).cast("string").alias(c) for c in shared])
        return df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.any_value(cells).alias(name))

    a, b = single(produced, "produced"), single(reference, "reference").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    both = a.join(b, same, "full_outer").select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys], F.coalesce("n_produced", F.lit(0)).alias("n_produced"),
        F.coalesce("n_reference", F.lit(0)).alias("n_reference"), "produced", "reference",
    )
    rows = F.struct(F.lit("<row>").alias("column"), F.col("n_produced").cast("string").alias("produced"), F.col("n_reference").cast("string").alias("reference"))
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"produced.{c}").alias("produced"), F.col(f"reference.{c}").alias("reference")) for c in shared]
    uneven = F.col("n_produced") != F.col("n_reference")
    one = (F.col("n_produced") == 1) & (F.col("n_reference") == 1)
    listed = F.when(uneven, F.array(rows)).when(one, F.array(*cells)).otherwise(F.array().cast("array<struct<column:string,produced:string,reference:string>>"))
    long = both.select(*keys, F.explode(listed).alias("c")).select(*keys, "c.*")
    p, r = F.col("produced").try_cast("double"), F.col("reference").try_cast("double")
    close = F.when(p.isNotNull() & r.isNotNull(), F.abs(p - r) <= F.lit(float(tol))).otherwise(
        F.trim("produced").eqNullSafe(F.trim("reference"))
    )
    diffs = long.where((F.col("column") == "<row>") | ~close)
    if missing:
        schema = ", ".join(f"`{k}` {reference.schema[k].dataType.simpleString()}" for k in keys)
        absent = [(*[None] * len(keys), c, None, "<missing column>") for c in missing]
        diffs = diffs.unionByName(reference.sparkSession.createDataFrame(absent, f"{schema}, column string, produced string, reference string"))
    return diffs
