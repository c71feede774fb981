"""Message ingest: parse, validate, write good rows and quarantine the others."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from plantpulse.functions.columns import share
from plantpulse.functions.validate import stream_reason
from plantpulse.schemas import METRIC_MAP, READINGS
from plantpulse.sinks.tables import gathered
from plantpulse.sources.messages import parse_messages, to_readings

# Flush interval, and how far apart repeats of a reading are recognised.
FLUSH_INTERVAL = "5 seconds"
DEDUP_DELAY = "10 minutes"


def screened(messages: DataFrame, value: str = "value") -> DataFrame:
    """Message columns plus `raw` and `reason`; reason is NULL for accepted rows."""
    parsed = parse_messages(messages, value)
    return parsed.withColumn("reason", F.coalesce("parse_error", stream_reason())).drop("parse_error")


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def ingest_writer(path: str):
    """Writer of one micro-batch: one pass, accepted and rejected rows side by side.

    Rows go to `rows/batch_id=N/outcome=accepted|rejected/dt=...`. The folder of a batch is overwritten,
    so a batch that is replayed after a failure replaces its own earlier output and nothing is stored
    twice. Counts and time of the batch go to `runs`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        seen = Observation()
        ok = F.col("reason").isNull()
        rows = screened(batch).observe(seen, F.count("*").alias("rows"), F.count_if(~ok).alias("failed"))
        wide = to_readings(rows, "metrics", "raw", "reason")
        split = wide.withColumns({
            "raw": F.when(~ok, F.col("raw")), "outcome": F.when(ok, "accepted").otherwise("rejected"),
            "dt": F.when(ok, F.date_format("event_time", "yyyy-MM-dd"))})
        (gathered(split, "outcome", "dt").write.mode("overwrite").partitionBy("outcome", "dt")
         .parquet(batch_folder(f"{path}/rows", batch_id)))
        counts = seen.get
        batch.sparkSession.createDataFrame(
            [(int(counts["rows"]), int(counts["failed"]), float((time.monotonic() - started) * 1000))],
            "records long, failed_records long, duration_ms double",
        ).coalesce(1).write.mode("overwrite").parquet(batch_folder(f"{path}/runs", batch_id))

    return write


def start_ingest(messages: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                 interval: str = FLUSH_INTERVAL):
    """Start the pipeline on a stream with a `value` column. Batch size is set at the source."""
    writer = messages.writeStream.foreachBatch(ingest_writer(path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _stored(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    schema = T.StructType([*READINGS.fields, T.StructField("metrics", METRIC_MAP),
                           *[T.StructField(n, T.StringType()) for n in ("raw", "reason", "outcome", "dt")]])
    return spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("outcome") == outcome)


def ingested(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """Accepted readings; `more` may name `metrics`, the whole map of the message, and `dt`, which prunes folders."""
    return _stored(spark, path, "accepted").select(*READINGS.fieldNames(), *more)


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, "rejected").select("raw", "reason")


def processing_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row over all micro-batches: rows, failures, success percent, last batch's size and time."""
    runs = spark.read.parquet(f"{path}/runs")
    return runs.agg(
        F.sum("records").alias("total_processed"), F.sum("failed_records").alias("total_errors"),
        F.max_by("records", "batch_id").alias("last_batch_size"),
        F.max_by("duration_ms", "batch_id").alias("last_processing_ms"),
    ).withColumn("success_rate", share(F.col("total_processed") - F.col("total_errors"), "total_processed") * 100)


def stream_time(readings: DataFrame) -> DataFrame:
    """Event time with a zone, which watermarks need; the session zone is UTC."""
    return readings.withColumn("event_time", F.col("event_time").cast("timestamp"))


def plain_time(readings: DataFrame) -> DataFrame:
    return readings.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def deduplicated(readings: DataFrame, delay: str = DEDUP_DELAY) -> DataFrame:
    """Stream without repeated data_id. State is dropped once a repeat could no longer arrive in time."""
    return plain_time(stream_time(readings).withWatermark("event_time", delay)
                      .dropDuplicatesWithinWatermark(["data_id"]))


def windowed_metrics(readings: DataFrame, width: str = "1 hour", delay: str = DEDUP_DELAY) -> DataFrame:
    """Count and mean temperature per time window and sensor type, on a stream or a table."""
    timed = stream_time(readings)
    if readings.isStreaming:
        timed = timed.withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", width), "sensor_type").agg(
        F.count("*").alias("n"), F.avg("temperature").alias("avg_temperature"),
    ).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "sensor_type", "n", "avg_temperature")


def run_to_end(writer, timeout: float | None = None) -> None:
    """Process what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError("the stream did not finish in time")


def collect_stream(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over the files that are there and read back what it wrote.

    Append results go through the file sink; update and complete results are stored per batch, and
    for complete mode the last batch is the answer.
    """
    spark = stream.sparkSession
    out, marks = f"{path}/out", f"{path}/checkpoint"
    if mode == "append":
        run_to_end(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks))
        return spark.read.schema(stream.schema).parquet(out)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    run_to_end(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks))
    rows = spark.read.parquet(out)
    if mode == "complete":
        rows = rows.filter(F.col("batch_id") == rows.agg(F.max("batch_id")).scalar())
        return rows.drop("batch_id")
    return rows

