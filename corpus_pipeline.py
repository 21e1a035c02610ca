"""The corpus pipeline: from raw documents to token ids in training order.

Each stage works on all that its predecessor kept, and its decisions take effect:

1. quality: documents that the weakly supervised classifier rejects go;
2. line_dedup: later copies of repeated runs of lines go, and documents left without any word with them;
3. near_dedup: one document of each class of near duplicates stays;
4. mixing: documents are repeated, or left out, as their source's target asks,
   and stand in training order; the last copy taken of a source is cut at the
   word where the target is reached;
5. bpe: every text is encoded to token ids.

Nulls, empty tables and repeated rows are handled as the operators say; a
document without words ends at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from escalade.llm import curriculum, line_dedup, quality, weighted_minhash, word_bpe
from escalade.llm.frames import BATCH_SETTING, lean_batches, read, settle, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _prepare(spark: SparkSession) -> None:
    """The package and, as every stage hands whole texts to Python workers, small batches for the rest of the session."""
    ship_package(spark)
    lean_batches(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    _prepare(spark)
    return quality.score(docs, quality.fit(docs)).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; ``n_chars`` follows the text."""
    _prepare(spark)
    left = line_dedup.dedup_lines(docs)
    return left.where((F.col("n_removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class of near duplicates, once; every row with a null doc_id, and every text of a kept doc_id."""
    _prepare(spark)
    kept = weighted_minhash.near_classes(docs).where("kept").select(*COLUMNS)
    named = kept.where(F.col("doc_id").isNotNull())
    # One row of those that repeat doc_id and text: the one with the least other columns.
    others = F.struct(*[F.col(c) for c in COLUMNS if c not in ("doc_id", "text")])
    once = named.groupBy("doc_id", "text").agg(F.min(others).alias("o")).select("doc_id", "text", "o.*")
    return once.select(*COLUMNS).unionByName(kept.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes, in training order."""
    _prepare(spark)
    sized = docs.withColumn("size", curriculum.word_count(F.col("text")))
    copies = curriculum.training_order(curriculum.place_documents(sized, curriculum.cyclic_schedule))
    text = F.when(F.col("words") < F.col("size"), curriculum.first_words(F.col("text"), F.col("words"))).otherwise(F.col("text"))
    return copies.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every copy."""
    _prepare(spark)
    encoded = word_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode_texts),
]

#: A fitted scorer, sampled signatures and a tokenizer have no SQL form; the tests follow each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; the session's size of batches is put back."""
    rows = spark.conf.get(BATCH_SETTING)
    try:
        docs = read(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return docs
    finally:
        spark.conf.set(BATCH_SETTING, rows)
