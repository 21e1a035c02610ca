"""Readers and writers, exercised on files derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import OUTCOME_COLUMNS, TOKEN_COLUMNS
from ..operators.reports import coverage_table
from ..operators.runlog import explode_events, flatten_run_log
from ..session import new_folder
from ..sources import problems as pb
from ..sources import tables as tb
from . import bindings as b
from .base import BASE, RUN, query, with_
from .outcomes import COVER, DIM_SQL, _dim


def _full(spark, sf):
    """A matched table with every required column, outcomes as text."""
    m = b.labelled(spark, sf)
    text = [F.when(F.col(c), "1").otherwise("0").alias(c) for c in OUTCOME_COLUMNS.values()]
    extra = {"benchmark_id": "bench", "slice_id": "all", "run_id": "r1", "model": "m"}
    return m.select(
        "setting", *[F.lit(v).alias(k) for k, v in extra.items()], "model_endpoint", "domain", "problem_uid", "problem", "source",
        "difficulty", "difficulty_tier", *text, *TOKEN_COLUMNS.values(), "oracle_label",
    )


LISTED = "listed AS (SELECT * FROM lab WHERE setting IN (SELECT setting FROM dim) )"
ROWS = "problem_uid, setting, problem, difficulty, difficulty_tier, baseline_correct, broadcast_correct, broadcast_tokens, oracle_label"


def _listed_dim(spark):
    return _dim(spark).where("setting <> 'ABSENT'")


@query("read_matched_dir", with_(*BASE, DIM_SQL, LISTED) + f"SELECT {ROWS} FROM listed")
def read_matched_dir(spark, sf):
    path = new_folder(spark, "matched-dir")
    tb.write_matched(_full(spark, sf).drop("oracle_label"), path)
    return tb.read_matched(spark, path, _listed_dim(spark), unit="folder").select(*ROWS.split(", "))


@query("read_matched_combined", with_(*BASE, DIM_SQL, LISTED) + f"SELECT {ROWS}, CASE WHEN pk % 5 = 0 THEN 'none' ELSE oracle_label END AS oracle_cheapest_successful FROM listed")
def read_matched_combined(spark, sf):
    path = new_folder(spark, "matched-combined")
    stale = F.when(F.col("problem_uid").cast("bigint") % 5 == 0, "none").otherwise(F.col("oracle_label"))
    one = _full(spark, sf).withColumn("oracle_label", stale).withColumnsRenamed({"setting": "setting_id", "problem_uid": "problem_id"})
    one.write.option("header", True).option("escape", '"').csv(path)
    return tb.read_matched(spark, path, _listed_dim(spark)).select(*ROWS.split(", "), "oracle_cheapest_successful")


@query("read_table", "SELECT CAST(p_partkey AS VARCHAR) AS problem_uid, (['Baseline','single','PER','broadcast','unsolved'])[(p_partkey * 7 + 3) % 5 + 1] AS predicted_label FROM part")
def read_table(spark, sf):
    path = new_folder(spark, "predictions")
    b.predictions(spark, sf).withColumn("extra", F.lit("x")).write.option("header", True).csv(path)
    return tb.read_table(spark, path, "predictions")


@query("write_report", with_(*BASE) + f"SELECT setting, count(*) AS n, {COVER} FROM lab GROUP BY setting")
def write_report(spark, sf):
    table = coverage_table(b.labelled(spark, sf))
    path = tb.write_report(table, new_folder(spark, "report"), "parquet")
    return spark.read.parquet(path)


# --- problems ---------------------------------------------------------------


def _records(spark, sf):
    """Raw problem records of ``documents`` with fields missing or blank by id."""
    d = F.col("doc_id")
    return b.table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 3 != 0, d.cast("string")).alias("id"),
        F.when(d % 2 == 0, F.col("text")).alias("question"),
        F.when(d % 2 == 1, F.col("text")).otherwise("  ").alias("problem"),
        F.when(d % 4 == 0, "None").when(d % 4 == 1, "").otherwise(F.concat(F.lit("a"), d.cast("string"))).alias("answer"),
        F.when(d % 4 < 2, F.concat(F.lit(" "), (d * 3).cast("string"))).alias("answer_number"),
        F.when(d % 5 == 0, F.concat(F.lit("because "), d.cast("string"))).alias("solution"),
        F.col("lang").alias("domain"), "source",
    )


def _map(df):
    cols = [c for c in df.columns if c != "doc_id"]
    return df.select("doc_id", F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols])).alias("row"))


RECORDS = """rec AS (SELECT *, doc_id AS d, CASE WHEN doc_id % 4 = 0 THEN 'None' WHEN doc_id % 4 = 1 THEN '' ELSE concat('a', CAST(doc_id AS VARCHAR)) END AS ans,
  CASE WHEN doc_id % 4 < 2 THEN CAST(doc_id * 3 AS VARCHAR) ELSE '' END AS num,
  CASE WHEN doc_id % 5 = 0 THEN concat('because ', CAST(doc_id AS VARCHAR)) ELSE '' END AS sol,
  regexp_replace(text, '^[\\s\\p{Z}\\x1c-\\x1f\\x85]+|[\\s\\p{Z}\\x1c-\\x1f\\x85]+$', '', 'g') AS body FROM documents)"""
FIRST = "CASE WHEN num <> '' THEN num ELSE ans END"
SECOND = "CASE WHEN ans <> '' THEN ans ELSE num END"


@query("normalize_fields", with_(RECORDS) + f"""
SELECT 'omni-math' AS loader, CASE WHEN d % 3 <> 0 THEN CAST(d AS VARCHAR) ELSE concat('omnimath_', CAST(d AS VARCHAR)) END AS id,
  md5(body) AS input_md5, {FIRST} AS answer, sol AS reference_solution, concat(lang, '|', source) AS metadata FROM rec
UNION ALL SELECT 'jsonl', CASE WHEN d % 3 <> 0 THEN CAST(d AS VARCHAR) ELSE concat('row_', CAST(d AS VARCHAR)) END,
  md5(body), {SECOND}, sol, concat(lang, '|', source) FROM rec""")
def normalize_fields(spark, sf):
    rows = _map(_records(spark, sf))
    frames = []
    for loader in ("omni-math", "jsonl"):
        out = pb.normalize_fields(rows, loader, fallback_id=F.col("doc_id"))
        frames.append(out.select(
            F.lit(loader).alias("loader"), "id", F.md5(F.col("input").cast("binary")).alias("input_md5"), "answer", "reference_solution",
            F.concat(F.col("metadata")["domain"], F.lit("|"), F.col("metadata")["source"]).alias("metadata"),
        ))
    return frames[0].unionByName(frames[1])


@query("read_problems", with_(RECORDS) + f"SELECT md5(body) AS input_md5, {FIRST} AS answer, source FROM rec")
def read_problems(spark, sf):
    path = new_folder(spark, "problems")
    _records(spark, sf).drop("doc_id").write.json(path)
    found, _bad = pb.read_problems(spark, path, "omni-math")
    return found.select(F.md5(F.col("input").cast("binary")).alias("input_md5"), "answer", F.col("metadata")["source"].alias("source"))


@query("dataset_fingerprint", """WITH h AS (SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), sha256(text), sha256(source))) AS h FROM documents)
SELECT CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % 16 AS bucket, count(*) AS n,
  CAST(CAST(sum(CAST(concat('0x', substr(h, 9, 8)) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS hash_sum FROM h GROUP BY 1""")
def dataset_fingerprint(spark, sf):
    return pb.fingerprint(b.table(spark, sf, "documents"), ("doc_id", "text", "source"))


# --- run logs ---------------------------------------------------------------


def _run_records(spark, sf):
    """Nested run records, one event per hundred tokens or part of it."""
    r = b.runs(spark, sf)
    n = (F.floor(F.col("tokens") / 100) + 1).cast("int")
    event = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.lit("message").alias("type"), F.concat(F.lit("step_"), i.cast("string")).alias("stage"), F.lit("solver").alias("role"),
        F.lit("Solver").alias("sender"), F.concat(F.lit("text "), i.cast("string")).alias("content"),
        F.struct(i.cast("bigint").alias("prompt"), (i * 2).cast("bigint").alias("completion")).alias("tokens"),
        F.lit("").alias("error"), F.lit(1).alias("attempts"),
    ))
    verdict = F.array(F.struct(F.col("passed"), F.col("passed").cast("int").alias("correctness"), F.lit(1).alias("judge_calls")))
    return r.select(
        F.col("problem_uid").alias("problem_id"), F.lower(F.trim("protocol")).alias("protocol"), F.lit("m").alias("model_id"),
        F.concat(F.lit("ans "), F.col("problem_uid")).alias("final_answer"), "passed", F.col("passed").cast("int").alias("correctness"),
        n.alias("rounds_used"), F.when(F.col("passed"), "evaluator_pass").otherwise("max_rounds_exhausted").alias("stop_reason"),
        n.alias("judge_calls"), (F.col("tokens") % 7 == 0).alias("direct_protocol_fail"), F.lit(False).alias("judge_unparseable"),
        verdict.alias("evaluations"),
        F.struct(F.col("tokens").alias("prompt_tokens"), (F.col("tokens") * 2).alias("completion_tokens"), n.cast("bigint").alias("calls"),
                 n.cast("bigint").alias("http_attempts"), (F.col("tokens") * 3).alias("total_tokens")).alias("tokens"),
        (F.col("tokens") / F.lit(8.0)).alias("wall_seconds"), event.alias("events"),
    )


def _log(spark, sf):
    path = new_folder(spark, "run-log")
    tb.write_run_log(_run_records(spark, sf), path)
    return tb.read_run_log(spark, path)


N = "CAST(floor(CAST(tokens AS DOUBLE) / 100) + 1 AS INTEGER)"
NAME = "(['baseline', 'single_agent', 'per', 'broadcast'])[ln]"


@query("write_run_log", with_(RUN) + f"""
SELECT CAST(pk AS VARCHAR) AS problem_id, {NAME} AS protocol, concat('ans ', CAST(pk AS VARCHAR)) AS final_answer, passed,
  CAST(passed AS INTEGER) AS correctness, {N} AS rounds_used, CASE WHEN passed THEN 'evaluator_pass' ELSE 'max_rounds_exhausted' END AS stop_reason,
  {N} AS judge_calls, tokens % 7 = 0 AS direct_protocol_fail, tokens AS prompt_tokens, tokens * 2 AS completion_tokens, tokens * 3 AS total_tokens,
  CAST({N} AS BIGINT) AS llm_calls, CAST(tokens AS DOUBLE) / 8 AS wall_seconds FROM run""")
def write_run_log(spark, sf):
    return flatten_run_log(_log(spark, sf))


@query("explode_events", with_(RUN) + f"""
SELECT {NAME} AS protocol, concat('step_', CAST(i AS VARCHAR)) AS stage, count(*) AS n, CAST(sum(i) AS BIGINT) AS prompt_tokens,
  CAST(sum(2 * i) AS BIGINT) AS completion_tokens FROM (SELECT ln, unnest(range(1, {N} + 1)) AS i FROM run) GROUP BY 1, 2""")
def events_query(spark, sf):
    return explode_events(_log(spark, sf)).groupBy("protocol", "stage").agg(
        F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens")
    )
