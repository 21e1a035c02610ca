"""Files in and out: matched tables, keyed tables, problems, run logs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import REQUIRED_COLUMNS, SETTINGS, setting_dim
from ..operators.matched import MatchedTableError, assert_valid, require_columns, with_oracle_label
from ..operators.settings import filter_settings, missing_settings

MATCHED_SCHEMA = (
    "setting string, benchmark_id string, slice_id string, run_id string, model string, model_endpoint string, "
    "domain string, problem_uid string, problem string, source string, difficulty double, difficulty_tier int, "
    "baseline_correct string, single_correct string, per_correct string, broadcast_correct string, "
    "confidence_raw string, baseline_tokens bigint, single_tokens bigint, per_tokens bigint, broadcast_tokens bigint"
)

RUN_LOG_SCHEMA = (
    "problem_id string, protocol string, model_id string, evaluator_model_id string, final_answer string, "
    "final_text string, passed boolean, correctness int, rounds_used int, stop_reason string, judge_calls int, "
    "direct_protocol_fail boolean, judge_unparseable boolean, "
    "evaluations array<struct<passed: boolean, correctness: int, signal: string, mode: string, final_answer: string, "
    "advice: string, direct_protocol_fail: boolean, direct_protocol_fail_reason: string, judge_calls: int, "
    "judge_unparseable: boolean>>, "
    "tokens struct<prompt_tokens: bigint, completion_tokens: bigint, calls: bigint, http_attempts: bigint, "
    "total_tokens: bigint>, wall_seconds double, error string, "
    "events array<struct<type: string, stage: string, role: string, sender: string, content: string, "
    "tokens: struct<prompt: bigint, completion: bigint>, error: string, attempts: int>>, output_schema_version string"
)

KEYED_SCHEMAS = {
    "predictions": "problem_uid string, predicted_label string",
    "split": "problem_uid string, split string",
    "confidence": "problem_uid string, probability string, baseline_correct string, single_correct string",
    "crosswalk": "example_id string, uid_a string, uid_b string",
}


def _read_strings(spark: SparkSession, path: str, suffix: str = "csv") -> DataFrame:
    """CSV with a header, every cell as text: inference would turn 1/0 with a blank into floats."""
    return (
        spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", False)
        .option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).csv(path)
    )


def _typed(df: DataFrame) -> DataFrame:
    """Cast the known numeric columns; outcomes stay text until parsed strictly."""
    types = {f.name: f.dataType for f in T.StructType.fromDDL(MATCHED_SCHEMA).fields}
    return df.withColumns({
        c: F.col(c).try_cast(types[c]) for c in df.columns if c in types and not isinstance(types[c], T.StringType)
    })


def _check_places(inventory: DataFrame, dim: DataFrame | None, one_each: bool, path: str) -> None:
    """Missing settings, sources that mix settings, settings in two sources."""
    if dim is not None:
        absent = [r["setting"] for r in missing_settings(inventory, dim).collect()]
        if absent:
            raise MatchedTableError(f"missing settings in {path}: {sorted(absent)}")
    if inventory.isEmpty():
        raise MatchedTableError(f"{path}: table is empty")
    if one_each:
        listed = filter_settings(inventory, dim) if dim is not None else inventory
        for key, other, reason in (("_source", "setting", "mixed_settings"), ("setting", "_source", "settings in more than one source")):
            twice = listed.groupBy(key).agg(F.count("*").alias("k")).where("k > 1").limit(5).collect()
            if twice:
                raise MatchedTableError(f"{path}: {reason}: {sorted(str(r[key]) for r in twice)}")


def read_matched(spark: SparkSession, path: str, settings: DataFrame | None = None, strict: bool = True,
                 unit: str = "file", validate: bool = True) -> DataFrame:
    """A matched outcome table from a folder of CSVs (or one combined CSV), labelled.

    In a folder each source holds one setting; ``unit`` says whether a source is
    a file or a sub-folder of part files (the form Spark writes and large
    settings need).  ``strict`` keeps listed settings only and fails when one is
    missing.  Column spellings of the combined form are accepted.
    """
    df = _read_strings(spark, path)
    place = F.col("_metadata.file_path")
    folder = F.regexp_replace(place, "/[^/]*$", "")
    df = df.select("*", (place if unit == "file" else folder).alias("_source"))
    combined = "setting_id" in df.columns
    if combined and "setting" not in df.columns:
        df = df.withColumnRenamed("setting_id", "setting")
    if "problem_uid" not in df.columns and "problem_id" in df.columns:
        df = df.withColumn("problem_uid", F.col("problem_id"))
    if "setting" not in df.columns:
        raise MatchedTableError(f"{path} has neither a setting_id nor a setting column")
    require_columns(df, REQUIRED_COLUMNS, path)
    dim = settings if settings is not None else setting_dim(spark, SETTINGS)
    if strict or validate:
        # One pass lists which setting occurs in which source; every check on
        # places works on that list.
        inventory = df.groupBy("_source", "setting").agg(F.count("*").alias("n")).persist()
        try:
            _check_places(inventory, dim if strict else None, validate and not combined, path)
        finally:
            inventory.unpersist()
    if strict:
        df = filter_settings(df, dim)
    if validate:
        assert_valid(df)
    return with_oracle_label(_typed(df.drop("_source")), parse=True)


def write_matched(df: DataFrame, path: str) -> None:
    """A matched table as CSV, one sub-folder per setting, any number of part files each."""
    df.withColumn("_folder", F.col("setting")).write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("_folder").csv(path)


def read_table(spark: SparkSession, path: str, kind: str, fmt: str = "csv", columns: str | None = None) -> DataFrame:
    """Prediction, split, confidence or crosswalk table; a missing column is an error."""
    schema = T.StructType.fromDDL(columns or KEYED_SCHEMAS[kind])
    if fmt == "csv":
        df = _read_strings(spark, path)
    else:
        df = spark.read.format(fmt).load(path)
    require_columns(df, [f.name for f in schema.fields], path)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Run records with their nested evaluations, tokens and events."""
    return spark.read.schema(RUN_LOG_SCHEMA).json(path)


def write_run_log(df: DataFrame, path: str) -> None:
    """One JSON object per problem, one sub-folder per protocol."""
    df.withColumn("_protocol", F.col("protocol")).write.mode("overwrite").partitionBy("_protocol").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv", columns: list[str] | None = None) -> str:
    """Write a result table in a stable column order; an empty one is refused."""
    out = df.select(*(columns or df.columns))
    if out.isEmpty():
        raise ValueError(f"refusing to write an empty table to {path}")
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path
