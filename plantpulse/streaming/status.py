"""Latest robot status from a stream of heartbeats."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.operators.robots import with_freshness
from plantpulse.session import path_exists
from plantpulse.streaming.ingest import batch_folder

# Batches between two snapshots of all robots.
SNAPSHOT_EVERY = 100


def latest_stream(heartbeats: DataFrame) -> DataFrame:
    """Running last status per robot. The aggregate combines map-side, so a chatty robot costs one row
    per task; use update mode to emit changed robots only."""
    return heartbeats.groupBy("robot_id").agg(
        F.max_by("status", F.struct("event_time", "data_id")).alias("reported_status"),
        F.max("event_time").alias("last_update_time"))


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("robot_id").agg(
        F.max_by("reported_status", F.struct("last_update_time", "reported_status")).alias("reported_status"),
        F.max("last_update_time").alias("last_update_time"))


def status_writer(path: str, every: int = SNAPSHOT_EVERY):
    """Stores the changed robots of each batch and, every so many batches, the state of all robots.

    A snapshot comes from the one before it and the changes since, so readers never go further back.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(f"{path}/changes", batch_id))
        if batch_id % every == 0 and batch_id > 0:
            spark = batch.sparkSession
            _latest(_since(spark, path, batch_id - every, batch_id)).write.mode("overwrite").parquet(
                batch_folder(f"{path}/snapshots", batch_id))

    return write


def _since(spark: SparkSession, path: str, snapshot: int, last: int | None = None) -> DataFrame:
    """Rows of a snapshot (0: none yet) and of the changes after it."""
    changes = spark.read.parquet(f"{path}/changes")
    newer = F.col("batch_id") > snapshot if snapshot > 0 else F.lit(True)
    if last is not None:
        newer = newer & (F.col("batch_id") <= last)
    rows = changes.filter(newer).select("robot_id", "reported_status", "last_update_time")
    if snapshot > 0:
        rows = rows.unionByName(spark.read.parquet(batch_folder(f"{path}/snapshots", snapshot)))
    return rows


def start_status(heartbeats: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                 every: int = SNAPSHOT_EVERY):
    writer = (latest_stream(heartbeats).writeStream.outputMode("update").foreachBatch(status_writer(path, every))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()


def current_status(spark: SparkSession, path: str, now: datetime, timeout_seconds: int = 30) -> DataFrame:
    """The state at `now`: last emitted row per robot, OFFLINE when older than the timeout.

    Staleness depends on the moment of asking, so it is decided here and not stored.
    """
    snapshot = 0
    if path_exists(spark, f"{path}/snapshots"):
        snapshot = spark.read.parquet(f"{path}/snapshots").agg(F.max("batch_id")).first()[0]
    return with_freshness(_latest(_since(spark, path, snapshot)), now, timeout_seconds)
