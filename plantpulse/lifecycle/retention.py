"""Deleting old data, previewing that, and storage figures."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.session import folder_names, move_path, path_exists, remove_path
from plantpulse.sinks.tables import checked_name
from plantpulse.sources.tables import file_listing, since_until

# Fixed value: days kept.
RETENTION_DAYS = 90
STAGED = "_staged_dt="
DROPPED_AT_ONCE = 500


def cutoff(now: datetime, days: int = RETENTION_DAYS) -> datetime:
    return now - timedelta(days=days)


def kept(readings: DataFrame, before: datetime) -> DataFrame:
    """Rows that survive: everything not strictly older than the cutoff."""
    return since_until(readings, start=before)


def delete_older(spark: SparkSession, path: str, before: datetime) -> None:
    """Delete rows older than the cutoff from a folder partitioned by `dt`.

    Whole older days are removed as folders, found by listing. Only the day of the cutoff is rewritten: next to the
    table first, then put in its place by a rename. A run that broke off in between is completed by the next one.
    """
    recover_staged(spark, path)
    day = f"{before:%Y-%m-%d}"
    days = [n.removeprefix("dt=") for n in folder_names(spark, path) if n.startswith("dt=")]
    for old in days:
        if old < day:
            remove_path(spark, f"{path}/dt={old}")
    if before > datetime(before.year, before.month, before.day) and day in days:
        staged = f"{path}/{STAGED}{day}"
        kept(spark.read.parquet(f"{path}/dt={day}"), before).write.mode("overwrite").parquet(staged)
        remove_path(spark, f"{path}/dt={day}")
        move_path(spark, staged, f"{path}/dt={day}")


def recover_staged(spark: SparkSession, path: str) -> None:
    """Put a finished rewrite in its place if the old day is gone already; drop it otherwise."""
    names = folder_names(spark, path)
    for name in names:
        if name.startswith(STAGED):
            day = f"dt={name.removeprefix(STAGED)}"
            if day not in names and path_exists(spark, f"{path}/{name}/_SUCCESS"):
                move_path(spark, f"{path}/{name}", f"{path}/{day}")
            else:
                remove_path(spark, f"{path}/{name}")


def expired_partitions(spark: SparkSession, table: str, before: datetime) -> DataFrame:
    """Partition texts (`dt=.../hr=...`) of days wholly before the cutoff day."""
    parts = spark.sql(f"SHOW PARTITIONS {checked_name(table)}")
    day = F.regexp_extract("partition", "dt=([^/]+)", 1)
    return parts.filter(day < f"{before:%Y-%m-%d}")


def drop_expired_partitions(spark: SparkSession, table: str, before: datetime) -> list[str]:
    """Drop whole partitions, many in one statement; data files of other partitions are not touched."""
    gone = [r.partition for r in expired_partitions(spark, table, before).collect()]
    specs = ["PARTITION ({})".format(", ".join("{}='{}'".format(*p.split("=", 1)) for p in text.split("/"))) for text in gone]
    for first in range(0, len(specs), DROPPED_AT_ONCE):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(specs[first:first + DROPPED_AT_ONCE])}")
    return gone


def cleanup_preview(readings: DataFrame, before: datetime) -> DataFrame:
    """What a cleanup would remove: rows, days touched, oldest and newest. Counted per day first."""
    per_day = since_until(readings, before=before).groupBy(
        F.to_date("event_time").alias("day")).agg(
        F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    return per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_to_delete"),
        F.count("*").alias("affected_partitions"),
        F.min("first").alias("oldest"), F.max("last").alias("newest"))


def cleanup_bytes(spark: SparkSession, path: str, before: datetime) -> DataFrame:
    """Bytes and files in the day folders a cleanup would drop."""
    day = F.regexp_extract("path", "dt=([^/]+)", 1)
    return file_listing(spark, path).filter((day != "") & (day < f"{before:%Y-%m-%d}")).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def storage_stats(readings: DataFrame) -> DataFrame:
    """Rows, days, rows per day, oldest and latest reading."""
    per_day = readings.groupBy(F.to_date("event_time").alias("day")).agg(
        F.count("*").alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))
    return per_day.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("partition_count"),
        F.avg("n").alias("rows_per_day"), F.min("first").alias("oldest"), F.max("last").alias("latest"))


def storage_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Total bytes and files of a table folder, and bytes per partition day."""
    day = F.regexp_extract("path", "dt=([^/]+)", 1)
    return file_listing(spark, path).groupBy(day.alias("dt")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("files"))
