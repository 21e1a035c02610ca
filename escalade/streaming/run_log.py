"""Streams of run records: deduplicated log, running ledger, live gate.

Every query uses ``availableNow``, so a scheduled run drains what has arrived
and stops; progress is kept in the checkpoint folder and survives restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.confidence import confidence_gate, parse_confidence
from ..session import folders_in, new_folder, remove_folder

#: Folders that the keys of a run log are dealt to.
BUCKETS = 64


def _drain(stream: DataFrame, out: str, checkpoint: str, partition_by: str | None = None) -> None:
    writer = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.start().awaitTermination()


def append_new(out: str, keys=("problem_id", "protocol"), ts: str = "ts", buckets: int = BUCKETS):
    """A micro-batch's handler that writes the rows of keys which no earlier batch wrote.

    The written table is the memory: ``out/epoch=E/bucket=K`` holds what batch E
    added, dealt by the hash of the key.  A batch is reduced to the earliest row of
    each key, combining map-side, and anti-joined with the keys of earlier epochs
    in the buckets that it touches.  It then replaces its own folder as a whole, so
    a batch that is handled again, after a failure in the middle too, leaves the
    same rows.  A repeat is found however late it comes, and nothing is held in
    memory between batches.
    """
    keys = list(keys)

    def handle(batch: DataFrame, epoch: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        # Of rows with one key and time, the hash of the whole row decides.
        order = F.struct(F.col(ts), F.xxhash64(F.to_json(F.struct(*columns))))
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in columns if c not in keys]), order).alias("_row"))
        rows = first.select(*keys, "_row.*").select(*columns, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"))
        earlier = [f for f in folders_in(spark, out) if f.startswith("epoch=") and int(f[6:]) < epoch]
        if earlier:
            rows = rows.persist()
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select(*keys).schema)
            known = spark.read.schema(f"{schema}, bucket int, epoch bigint").option("basePath", out).parquet(*[f"{out}/{f}" for f in earlier])
            known = known.where(F.col("bucket").isin(touched)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bucket").alias("_bucket"))
            same = rows["bucket"] == known["_bucket"]
            for k in keys:
                same = same & rows[k].eqNullSafe(known[f"_{k}"])
            new = rows.join(known, same, "left_anti")
        else:
            new = rows
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/epoch={epoch}")
        rows.unpersist()

    return handle


def stream_run_log(stream: DataFrame, out: str, checkpoint: str, keys=("problem_id", "protocol"), ts: str = "ts", buckets: int = BUCKETS) -> None:
    """Append each (problem, protocol) once, however late it is repeated (see ``append_new``)."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    (
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append_new(out, keys, ts, buckets))
        .trigger(availableNow=True).start().awaitTermination()
    )


def stream_ledger(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Running totals per role (one row each), a folder per trigger; the latest complete one counts.

    A trigger writes one file, so a reader sees all of it or the folder of an
    earlier trigger; :func:`read_ledger` finds the latest.  The folder before the
    latest stays for those who are reading it, older ones go.
    """
    totals = stream.groupBy("role").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        for folder in folders_in(batch.sparkSession, out):
            if folder.startswith("epoch=") and int(folder[6:]) < epoch - 1:
                remove_folder(batch.sparkSession, f"{out}/{folder}")

    (
        totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
        .trigger(availableNow=True).start().awaitTermination()
    )


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """The totals of the latest trigger."""
    totals = spark.read.parquet(out)
    return totals.where(F.col("epoch") == totals.agg(F.max("epoch")).first()[0]).drop("epoch")


def stream_gate(stream: DataFrame, out: str, checkpoint: str, threshold: float = 70.0, raw: str = "confidence_raw") -> None:
    """Parse the confidence of arriving rows and gate them; stateless."""
    gated = stream.withColumn("confidence", parse_confidence(raw)).withColumn(
        "predicted_label", confidence_gate("confidence", threshold)
    )
    _drain(gated, out, checkpoint)


def folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and checkpoint folders below the shared folder."""
    base = new_folder(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
