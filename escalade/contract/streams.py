"""Streaming jobs over the event files, compared with their batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import run_log as st
from . import bindings as b
from .base import PARSED, RAW, query, with_
from .metrics import GATE_SQL
from .runlog import CALLS


def _stream(spark, sf):
    """``events`` as a file stream."""
    schema = b.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_run_log", "SELECT DISTINCT user_id AS problem_id, event_type AS protocol FROM events")
def stream_run_log(spark, sf):
    out, checkpoint = st.folders(spark, "stream-run-log")
    rows = _stream(spark, sf).withColumnsRenamed({"user_id": "problem_id", "event_type": "protocol"})
    st.stream_run_log(rows, out, checkpoint)
    return spark.read.parquet(out).select("problem_id", "protocol")


@query("stream_ledger", with_(CALLS) + """SELECT role, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM calls GROUP BY role""")
def stream_ledger(spark, sf):
    out, checkpoint = st.folders(spark, "stream-ledger")
    rows = _stream(spark, sf).select(
        F.col("event_type").alias("role"), F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("prompt_tokens"),
        F.floor("value").cast("bigint").alias("completion_tokens"),
    )
    st.stream_ledger(rows, out, checkpoint)
    return st.read_ledger(spark, out)


@query("stream_gate", with_(RAW, PARSED) + f"SELECT event_id, coalesce(confidence, -1) AS confidence, {GATE_SQL} AS predicted_label FROM parsed")
def stream_gate(spark, sf):
    out, checkpoint = st.folders(spark, "stream-gate")
    st.stream_gate(b.with_raw_confidence(_stream(spark, sf)), out, checkpoint)
    return spark.read.parquet(out).select("event_id", F.coalesce("confidence", F.lit(-1.0)).alias("confidence"), "predicted_label")
