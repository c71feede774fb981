"""Counters, rates and dashboard series."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from plantpulse.functions.columns import share
from plantpulse.functions.timefn import at, truncated
from plantpulse.schemas import METRICS
from plantpulse.sources.tables import since_until


def system_performance(readings: DataFrame, now: datetime, hours: int = 24,
                       table_name: str = "readings") -> DataFrame:
    """One row over the last hours: count, time span, distinct robots and sensors, rounded means.

    Aggregated per (robot, sensor) first: the distinct counts then run over that small table instead
    of multiplying the readings.
    """
    rows = since_until(readings, start=now - timedelta(hours=hours))
    pairs = rows.groupBy("robot_id", "sensor_id").agg(
        F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last"),
        *[c for m in METRICS for c in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"cnt_{m}"))])
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("first").alias("earliest_time"), F.max("last").alias("latest_time"),
        F.countDistinct("robot_id").alias("unique_robots"),
        F.countDistinct("sensor_id").alias("unique_sensors"),
        *[F.round(F.try_divide(F.sum(f"sum_{m}"), F.sum(f"cnt_{m}")), 2).alias(f"avg_{m}") for m in METRICS],
    ).select(F.lit(table_name).alias("table_name"), "*")


def counter(df: DataFrame, *labels: str) -> DataFrame:
    """Rows per combination of labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def timer(df: DataFrame, duration: str, *labels: str) -> DataFrame:
    """Count, total and maximum duration per combination of labels."""
    return df.groupBy(*labels).agg(
        F.count("*").alias("n"), F.sum(duration).alias("total_duration"), F.max(duration).alias("max_duration"))


def readings_by_type(readings: DataFrame) -> DataFrame:
    return counter(readings, "sensor_type")


def job_rates(runs: DataFrame) -> DataFrame:
    """One row: job success and record success in percent, 0 without jobs or records."""
    return runs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "SUCCESS").alias("successful_jobs"),
        F.count_if(F.col("status") == "FAILED").alias("failed_jobs"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("failed_records"), F.lit(0)).alias("failed_records"),
    ).withColumns({
        "success_rate": share("successful_jobs", "total_jobs") * 100,
        "record_success_rate": share(F.col("total_records") - F.col("failed_records"), "total_records") * 100,
    })


def message_rates(log: DataFrame) -> DataFrame:
    """One row over a message log with a boolean `acked`: sent, acknowledged, failed, percent."""
    return log.agg(
        F.count("*").alias("messages_sent"),
        F.count_if(F.col("acked")).alias("messages_acked"),
        F.count_if(~F.col("acked")).alias("messages_failed"),
    ).withColumn("success_rate", share("messages_acked", "messages_sent") * 100)


def rows_per_second(readings: DataFrame) -> DataFrame:
    return readings.groupBy(truncated("event_time", "second").alias("second")).agg(F.count("*").alias("n"))


def type_share(readings: DataFrame) -> DataFrame:
    """Readings per sensor type and their share of all, from one pass over the readings."""
    counted = readings_by_type(readings)
    return counted.withColumn("total", counted.agg(F.sum("n")).scalar()).withColumn(
        "share", F.col("n") / F.col("total")).drop("total")


def anomalies_per_hour(readings: DataFrame, limit: int = 3) -> DataFrame:
    """Readings outside 0..100 degrees per hour, flagged when there are more than `limit`."""
    t = F.col("temperature")
    return (
        readings.filter(~F.isnan(t) & ((t < 0) | (t > 100)))
        .groupBy(truncated("event_time", "hour").alias("hour")).agg(F.count("*").alias("n"))
        .withColumn("flagged", F.col("n") > limit))


def compression_statistics(tasks: DataFrame) -> DataFrame:
    """Sums over completed tasks and the saved share in percent."""
    return tasks.filter(F.col("status") == "COMPLETED").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
          for c in ("compressed_files", "original_size", "compressed_size")],
    ).withColumn("average_ratio", F.when(
        F.col("total_original_size") > 0,
        (F.lit(1.0) - F.col("total_compressed_size") / F.col("total_original_size")) * 100).otherwise(0.0))


def backup_statistics(tasks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Backup size and count, full and incremental counts, latest end, average size.

    Size and count come from the file listing when one is given, else from the task records.
    """
    stored = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"), F.count("*").alias("n")) if files is not None \
        else tasks.agg(F.coalesce(F.sum("backup_size"), F.lit(0)).alias("size"), F.count("*").alias("n"))
    kinds = tasks.agg(
        F.count_if(F.col("task_type") == "FULL_BACKUP").alias("full_backups"),
        F.count_if(F.col("task_type") == "INCREMENTAL_BACKUP").alias("incremental_backups"),
        F.max("end_time").alias("last_backup_time"))
    return kinds.withColumn("s", stored.select(F.struct("size", "n")).scalar()).select(
        F.col("s.size").alias("total_size"), F.col("s.n").alias("total_count"),
        "full_backups", "incremental_backups", "last_backup_time",
        F.coalesce(F.expr("CASE WHEN s.n > 0 THEN s.size DIV s.n END"), F.lit(0)).alias("average_size"))


def backup_report(tasks: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Totals over the tasks that started strictly inside the range."""
    inside = tasks.filter((F.col("start_time") > at(start)) & (F.col("start_time") < at(end)))
    return inside.agg(
        F.count("*").alias("total_backups"),
        F.coalesce(F.sum("backup_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("file_count"), F.lit(0)).alias("total_files"),
        F.count_if(F.col("status") == "COMPLETED").alias("succeeded"),
    ).withColumn("failed", F.col("total_backups") - F.col("succeeded"))
