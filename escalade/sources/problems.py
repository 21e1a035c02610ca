"""Problem files: normalized fields, loaders, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

# Field priorities.  The two loaders disagree on the answer on purpose.
FIELD_PRIORITY = {
    "omni-math": {
        "input": ("question", "problem"),
        "answer": ("answer_number", "answer", "label"),
        "reference_solution": ("equation_solution", "equation_answer", "solution"),
    },
    "jsonl": {
        "input": ("input", "question", "problem"),
        "answer": ("answer", "answer_number", "label"),
        "reference_solution": ("reference_solution", "solution"),
    },
}

# Metadata fields of the first loader; the second keeps all but
# the fields it reads.
OMNI_METADATA = ("dataset_name", "source", "difficulty", "difficulty_tier", "domain", "judge_type", "raw_difficulty")
GENERIC_DROPPED = (
    "input", "question", "problem", "answer", "answer_number", "label", "reference_solution", "solution", "id", "tools",
)

# Accepted loader names.
LOADER_NAMES = {
    "omni-math-2-filtered": "omni-math",
    "omni-math-rule": "omni-math",
    "omnimath": "omni-math",
    "omni-math": "omni-math",
    "generic": "jsonl",
    "generic-jsonl": "jsonl",
    "jsonl": "jsonl",
}


class ProblemFileError(ValueError):
    """A problem file that cannot be used."""


def normalize_loader(name: str | None) -> str:
    key = (name or "jsonl").strip().lower().replace("_", "-")
    if key not in LOADER_NAMES:
        raise ProblemFileError(f"unsupported loader {name!r}")
    return LOADER_NAMES[key]


def first_non_empty(row: Column, keys) -> Column:
    """First key of a text map whose trimmed value is not empty, else ''."""
    found = [F.nullif(strip(F.try_element_at(row, F.lit(k))), F.lit("")) for k in keys]
    return F.coalesce(*found, F.lit(""))


def normalize_fields(df: DataFrame, loader: str, row: str = "row", fallback_id: Column | None = None) -> DataFrame:
    """Raw records (a ``map<string,string>`` column) to ``id, input, answer, reference_solution, metadata``."""
    name = normalize_loader(loader)
    r = F.col(row)
    if name == "omni-math":
        kept = F.map_filter(r, lambda k, v: k.isin(*OMNI_METADATA) & v.isNotNull())
        prefix = "omnimath_"
    else:
        kept = F.map_filter(r, lambda k, v: ~k.isin(*GENERIC_DROPPED))
        prefix = "row_"
    given = F.nullif(F.try_element_at(r, F.lit("id")), F.lit(""))
    made = fallback_id if fallback_id is not None else F.sha1(F.to_json(r).cast("binary"))
    return df.select(
        F.coalesce(given, F.concat(F.lit(prefix), made.cast("string"))).alias("id"),
        *[first_non_empty(r, keys).alias(field) for field, keys in FIELD_PRIORITY[name].items()],
        kept.alias("metadata"),
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their place; ``row`` is NULL for a line that is not a JSON object.

    Values stay text whatever their JSON type, so one schema fits every file.
    ``at`` numbers the lines of a split in order, blank ones too.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    parsed = F.try_parse_json(strip("value"))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    row = F.when(is_object, F.from_json("value", "map<string,string>"))
    return lines.withColumn("row", row)


def with_line_numbers(places: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``line_number`` (from 1, within the file) to rows with file, block and at.

    The lines of the splits before are counted once; a file's splits are few, and only they are put in order.
    """
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = places.join(splits, ["file", "block"])
    return numbered.withColumn("line_number", F.col("at") - F.col("_first") + F.col("_before") + 1).drop("_first", "_before")


def read_problems(spark: SparkSession, path: str, loader: str = "jsonl") -> tuple[DataFrame, DataFrame]:
    """``(problems, violations)`` of a JSONL file or folder.

    Violations name the file, the number of the line, the reason, and the line.
    """
    raw = read_raw(spark, path)
    held = raw.where(strip("value") != "")
    good = normalize_fields(held.where("row IS NOT NULL").withColumn("_r", F.col("row")), loader, "_r")
    problems = good.where("input <> '' AND answer <> ''")
    fields = FIELD_PRIORITY[normalize_loader(loader)]
    reason = (
        F.when(F.col("row").isNull(), "invalid_json")
        .when(first_non_empty(F.col("row"), fields["input"]) == "", "no_question")
        .when(first_non_empty(F.col("row"), fields["answer"]) == "", "no_answer")
    )
    bad = held.withColumn("reason", reason).where("reason IS NOT NULL")
    return problems, with_line_numbers(bad, raw).select("file", "line_number", "reason", F.col("value").alias("line"))


def load_problems(spark: SparkSession, path: str, loader: str = "jsonl", expected_rows: int | None = None) -> DataFrame:
    """Like :func:`read_problems`, failing with the first five violations or a wrong count."""
    problems, bad = read_problems(spark, path, loader)
    first = bad.orderBy("file", "line_number").limit(5).collect()
    if first:
        raise ProblemFileError("; ".join(f"{r['reason']} in {r['file']}, line {r['line_number']}: {r['line']}" for r in first))
    if expected_rows is not None:
        n = problems.count()
        if n != expected_rows:
            raise ProblemFileError(f"loaded {n} rows, expected {expected_rows}")
    return problems


def fingerprint(df: DataFrame, cols=("id", "input", "answer"), buckets: int = 16) -> DataFrame:
    """Order-free content fingerprint: per bucket, row count and sum of hash prefixes.

    Each row is hashed on its own and the sums commute, so any partitioning
    gives the same table and any changed row changes it.
    """
    parts = [F.col(cols[0]).cast("string")] + [F.sha2(F.col(c).cast("string"), 256) for c in cols[1:]]
    rows = df.select(F.sha2(F.concat_ws("|", *parts), 256).alias("h"))
    hi = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring("h", 9, 8), 16, 10).cast("bigint")
    return rows.groupBy((hi % buckets).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(lo.cast("decimal(20,0)")).cast("string").alias("hash_sum")
    )
