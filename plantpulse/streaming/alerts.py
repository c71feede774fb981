"""Sustained-condition alerts and robot alerts on streams."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.functions.timefn import at, seconds_between
from plantpulse.operators.alerts import judged, parsed_rules
from plantpulse.operators.ordered import CHUNK, islands, with_chunk
from plantpulse.operators.robots import alert_messages, robot_alerts
from plantpulse.schemas import METRICS
from plantpulse.session import folder_names, remove_path, small
from plantpulse.streaming.ingest import batch_folder

FOREVER = datetime.max


def _open_runs(spark: SparkSession, path: str, batch_id: int, keys: list[str]) -> DataFrame:
    columns = ", ".join(f"{k} string" for k in ["rule_id", *keys])
    schema = f"{columns}, open_since timestamp_ntz, last_time timestamp_ntz, alerted boolean"
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_folder(f"{path}/open", batch_id - 1))


def _settled(batch: DataFrame, batch_id: int, path: str, delay_seconds: int, until: datetime | None = None) -> DataFrame:
    """The readings whose place in time is final now: nothing earlier than them is waited for any more.

    The mark is the latest time seen less the delay, and never goes back. Readings up to the mark are final, later
    ones wait in a folder of this batch, so what waits is what came within the delay. A reading at or before the
    former mark came too late, one without a time has no place: both go to the side table `late`.
    """
    spark = batch.sparkSession
    before = _mark(spark, path, batch_id - 1) if batch_id else None
    latest = batch.agg(F.max("event_time")).first()[0]
    marks = [m for m in (before, until, latest and latest - timedelta(seconds=delay_seconds)) if m is not None]
    mark = max(marks, default=None)
    spark.createDataFrame([(mark,)], "mark timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(
        batch_folder(f"{path}/mark", batch_id))
    placed = F.col("event_time").isNotNull() if before is None else F.coalesce(F.col("event_time") > at(before), F.lit(False))
    batch.filter(~placed).write.mode("overwrite").parquet(batch_folder(f"{path}/late", batch_id))
    rows = batch.filter(placed)
    if batch_id:
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(batch_folder(f"{path}/waiting", batch_id - 1)))
    final = F.lit(False) if mark is None else F.col("event_time") <= at(mark)
    rows.filter(~final).write.mode("overwrite").parquet(batch_folder(f"{path}/waiting", batch_id))
    for state in ("mark", "waiting") if until is None else ():
        remove_path(spark, batch_folder(f"{path}/{state}", batch_id - 2))
    return rows.filter(final)


def sustained_writer(rules: DataFrame, path: str, keys=("robot_id", "sensor_id"), chunk_seconds: int = 3600,
                     delay_seconds: int | None = None, until: datetime | None = None):
    """Writer that turns micro-batches of readings into alerts, one per run, when its duration is reached.

    Between batches only the runs that are still open are kept, one row per rule and key, in a folder
    named by the batch. They re-enter the next batch as two breaching marks (first and last time), so
    the batch operator answers the stream too, and a busy key is spread over time chunks as there. A
    replayed batch reads the same predecessor and overwrites its own output.

    Without a delay, readings must come in time order. With one they may come in any order within it: a
    reading is judged when it is final, so the alerts are those of the batch operator over the same readings,
    however they were cut into batches. An alert is then raised later by the delay, and never taken back. A
    clock that runs ahead moves the mark, so such readings should be refused by the ingest.
    """
    keys = list(keys)
    group = ["rule_id", *keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        active = parsed_rules(rules)
        came = batch.select(*keys, "event_time", "data_id", *METRICS)
        if delay_seconds is not None:
            came.persist()
        ready = came if delay_seconds is None else _settled(came, batch_id, path, delay_seconds, until)
        before = _open_runs(spark, path, batch_id, keys)
        marks = before.select(*group, F.explode(F.array("open_since", "last_time")).alias("event_time"), F.lit("").alias("data_id"))
        # readings and marks move to their key and chunk before readings fan out into one row per rule
        named = {r["metric"] for r in active.select("metric").distinct().collect()}
        asked = [m for m in METRICS if m in named] or list(METRICS[:1])
        slim = ready.select(*keys, "event_time", "data_id", *asked)
        placed = with_chunk(slim.unionByName(marks, allowMissingColumns=True), keys, "event_time", chunk_seconds).repartition(
            *keys, CHUNK)
        judgements = judged(placed.filter("rule_id IS NULL").drop("rule_id"), active, keys, asked)
        kept = placed.filter("rule_id IS NOT NULL").select(*group, "event_time", "data_id", CHUNK, F.lit(True).alias("breach"))
        rows, known = judgements.unionByName(kept).persist(), None
        try:
            runs = islands(rows, group, "event_time", "data_id", "breach", chunk_seconds)
            last = rows.groupBy(*group).agg(
                F.max_by("breach", F.struct("event_time", "data_id")).alias("still_on"),
                F.max("event_time").alias("last_seen"))
            known = (
                runs.join(small(active.select("rule_id", "duration", "severity", "alert_type")), "rule_id")
                .join(before.select(*group, "open_since", "alerted"), group, "left")
                .join(last, group)
                .withColumn("done", F.coalesce(
                    F.col("alerted") & F.col("open_since").between(F.col("start_time"), F.col("end_time")), F.lit(False)))
                .withColumn("due", seconds_between("start_time", "end_time") >= F.col("duration"))).persist()
            fresh = known.filter(F.col("due") & ~F.col("done"))
            fresh.select("rule_id", "alert_type", "severity", *keys, "start_time",
                         F.col("end_time").alias("raised_at")).write.mode("overwrite").parquet(
                batch_folder(f"{path}/alerts", batch_id))
            still_open = known.filter(F.col("still_on") & (F.col("end_time") == F.col("last_seen")))
            still_open.select(*group, F.col("start_time").alias("open_since"), F.col("end_time").alias("last_time"),
                              (F.col("done") | F.col("due")).alias("alerted")).groupBy(*group).agg(
                F.max("open_since").alias("open_since"), F.max("last_time").alias("last_time"),
                F.max_by("alerted", "open_since").alias("alerted"),
            ).write.mode("overwrite").parquet(batch_folder(f"{path}/open", batch_id))
            if until is None:  # a replay goes back one batch at most, from the newest of the stream itself
                remove_path(spark, batch_folder(f"{path}/open", batch_id - 2))
        finally:
            rows.unpersist()
            came.unpersist()
            if known is not None:
                known.unpersist()

    return write


def start_sustained(readings: DataFrame, rules: DataFrame, path: str, checkpoint: str,
                    keys=("robot_id", "sensor_id"), available_now: bool = False, chunk_seconds: int = 3600,
                    delay_seconds: int | None = None):
    writer = (readings.writeStream.foreachBatch(sustained_writer(rules, path, keys, chunk_seconds, delay_seconds))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()


def finish_sustained(spark: SparkSession, rules: DataFrame, path: str, keys=("robot_id", "sensor_id"),
                     chunk_seconds: int = 3600) -> None:
    """Judge the readings that still wait, as if nothing more came.

    The result stands in the place of the next batch: a stream that goes on starts from the state before it and
    overwrites it, so finishing early does no harm.
    """
    done = sorted(int(n.split("=")[1]) for n in folder_names(spark, f"{path}/open"))
    # the newest batch the checkpoint knows is the newest whose readings wait for a mark that is not the last one
    last = next((i for i in reversed(done) if _mark(spark, path, i) != FOREVER), None)
    if last is None:
        return
    waiting = spark.read.parquet(batch_folder(f"{path}/waiting", last))
    sustained_writer(rules, path, keys, chunk_seconds, 0, FOREVER)(waiting.limit(0), last + 1)


def _mark(spark: SparkSession, path: str, batch_id: int) -> datetime | None:
    return spark.read.parquet(batch_folder(f"{path}/mark", batch_id)).first()["mark"]


def too_late(spark: SparkSession, path: str) -> DataFrame:
    """Readings that were not judged: they came after their place in time was final, or have no time."""
    return spark.read.parquet(f"{path}/late").drop("batch_id")


def raised(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/alerts").drop("batch_id")


def robot_alert_messages(status_stream: DataFrame) -> DataFrame:
    """Alert messages for abnormal heartbeats, row by row, without state."""
    return alert_messages(robot_alerts(status_stream))
