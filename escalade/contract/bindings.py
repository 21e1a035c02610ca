"""Driver tables as the package's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import EXECUTIONS, SHORT, literal_map
from ..functions.confidence import parse_confidence
from ..functions.outcomes import difficulty_tier
from ..operators.matched import with_oracle_label
from ..operators.replay import replay

BY_LINE = {i + 1: p for i, p in enumerate(EXECUTIONS)}


_schemas: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from a footer once, not by a job per use."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """All lines; ``slot`` deals their seven numbers out to the four protocols."""
    return table(spark, sf, "lineitem").withColumn("slot", ((F.col("l_linenumber") - 1) % 4 + 1).cast("int"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Long run log: one row per (problem, protocol), protocols in mixed spellings."""
    li = lines(spark, sf)
    spelled = literal_map({1: "Baseline", 2: "single_agent", 3: " PER ", 4: "broadcast"})
    return (
        li.groupBy("l_partkey", "slot")
        .agg((2 * F.count_if(F.col("l_returnflag") == "R") < F.count("*")).alias("passed"),
             F.sum("l_quantity").cast("bigint").alias("q"))
        .select(F.col("l_partkey").alias("pk"), F.col("l_partkey").cast("string").alias("problem_uid"),
                F.element_at(spelled, F.col("slot")).alias("protocol"), "passed",
                (F.col("q") * F.col("slot")).alias("tokens"))
    )


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Wide outcomes in one aggregate over ``lineitem``, joined to the problem attributes."""
    li = lines(spark, sf)
    aggs = []
    for line, p in BY_LINE.items():
        mine = F.col("slot") == line
        aggs += [
            F.count_if(mine).alias(f"n{line}"),
            F.count_if(mine & (F.col("l_returnflag") == "R")).alias(f"r{line}"),
            F.sum(F.when(mine, F.col("l_quantity"))).cast("bigint").alias(f"q{line}"),
        ]
    wide = li.groupBy(F.col("l_partkey").alias("pk")).agg(*aggs)
    full = wide.where(" AND ".join(f"n{i} > 0" for i in BY_LINE))
    cols = [(2 * F.col(f"r{i}") < F.col(f"n{i}")).alias(f"{SHORT[p]}_correct") for i, p in BY_LINE.items()]
    cols += [(F.col(f"q{i}") * i).alias(f"{SHORT[p]}_tokens") for i, p in BY_LINE.items()]
    outcomes = full.select("pk", *cols)
    size = F.col("p_size").cast("double") / F.lit(4.0)
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pk"), F.col("p_type").alias("setting"), F.col("p_brand").alias("source"),
        F.col("p_name").alias("problem"), "p_size", size.alias("difficulty"), difficulty_tier(size).alias("difficulty_tier"),
        F.concat(F.lit('["'), F.lower("p_type"), F.lit('", "'), "p_name", F.lit('"]')).alias("domain"),
        F.concat(F.lit("endpoint/"), F.lower("p_type")).alias("model_endpoint"),
    )
    return outcomes.join(part, "pk").withColumn("problem_uid", F.col("pk").cast("string"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return with_oracle_label(matched(spark, sf))


def with_raw_confidence(events: DataFrame) -> DataFrame:
    """``event_id, k, confidence_raw``: six spellings by id."""
    k = F.regexp_extract("props", r"(\d+)", 1)
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit('{"PROBABILITY": '), k, F.lit("}")))
        .when(kind == 1, F.concat(F.lit("Probability : "), k))
        .when(kind == 2, F.concat(F.lit("  "), k, F.lit(" ")))
        .when(kind == 3, F.concat(F.lit("I am about "), k, F.lit(" percent sure")))
        .when(kind == 4, F.concat(F.lit('{"PROBABILITY": '), (k.cast("bigint") + 60).cast("string"), F.lit("}")))
        .otherwise("no idea")
    )
    return events.select("event_id", k.cast("bigint").alias("k"), text.alias("confidence_raw"))


def raw_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return with_raw_confidence(table(spark, sf, "events").select("event_id", "props"))


def confident(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with their parsed confidence."""
    raw = raw_confidence(spark, sf).select(F.col("event_id").alias("pk"), "confidence_raw")
    return labelled(spark, sf).join(raw, "pk").withColumn("confidence", parse_confidence("confidence_raw"))


def hash_prediction(key: str = "pk"):
    spelled = F.array(*[F.lit(x) for x in ("Baseline", "single", "PER", "broadcast", "unsolved")])
    return F.get(spelled, ((F.col(key) * 7 + 3) % 5).cast("int"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for every part, including problems that are not matched."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("problem_uid"), hash_prediction("p_partkey").alias("predicted_label")
    )


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    return replay(labelled(spark, sf).withColumn("predicted_label", hash_prediction()))
