"""Deterministic splits: label-stratified and by whole groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matched import with_oracle_label
from .ranks import hash_rank


@dataclass(frozen=True)
class SplitConfig:
    """Train and dev ratios; the rest is test."""

    train_ratio: float
    dev_ratio: float
    seed: int

    @classmethod
    def primary(cls) -> "SplitConfig":
        return cls(0.8, 0.1, 42)

    @classmethod
    def six_setting(cls) -> "SplitConfig":
        return cls(0.7, 0.15, 20260712)


def split_sizes(n: Column, train_ratio: float, dev_ratio: float) -> tuple[Column, Column]:
    """Train and dev sizes of a stratum: floors, with at least one each from three rows up."""
    tr = F.floor(n.cast("double") * F.lit(float(train_ratio)))
    dv = F.floor(n.cast("double") * F.lit(float(dev_ratio)))
    big = n >= 3
    tr = F.when(big & (tr == 0), F.lit(1)).otherwise(tr)
    dv = F.when(big & (dv == 0), F.lit(1)).otherwise(dv)
    empty_test = big & (n - tr - dv == 0)
    take_train = empty_test & (tr >= dv) & (tr > 1)
    take_dev = empty_test & ~take_train & (dv > 1)
    return tr - take_train.cast("int"), dv - take_dev.cast("int")


def stratified_split(df: DataFrame, config: SplitConfig | None = None, id_col: str = "problem_uid",
                     label_col: str = "oracle_label", hex_digits: int = 3, check: bool = False) -> DataFrame:
    """Add ``split``; the assignment depends on ids, labels and the seed only.

    Within a label, ids are ordered by a salted hash.  The rank is exact and
    spread over hash buckets (see ``ranks.hash_rank``), so five labels do not
    mean five tasks.
    """
    cfg = config or SplitConfig.primary()
    if label_col not in df.columns:
        df = with_oracle_label(df)
    if check:
        dup = df.groupBy(id_col).count().where("count > 1").limit(5).collect()
        if dup:
            raise ValueError(f"{id_col!r} must be unique: {[r[0] for r in dup]}")
    label = F.col(label_col).cast("string")
    material = F.concat_ws(":", F.lit(str(cfg.seed)), label, F.col(id_col).cast("string"))
    keyed = df.withColumn("_hash", F.sha2(material, 256)).withColumn("_label", label)
    ranked = hash_rank(keyed, "_label", "_hash", hex_digits)
    train, dev = split_sizes(F.col("group_size"), cfg.train_ratio, cfg.dev_ratio)
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + dev, "dev").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def group_holdout(df: DataFrame, group: str, fraction: float, seed: int = 42) -> DataFrame:
    """Keep whole groups out of training by a hash of the group; no shuffle."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10000
    return df.withColumn("split", F.when(bucket < int(round(fraction * 10000)), "holdout").otherwise("train"))


def refit_rows(df: DataFrame) -> DataFrame:
    """Rows used for the final fit."""
    return df.where(F.col("split").isin("train", "dev"))
