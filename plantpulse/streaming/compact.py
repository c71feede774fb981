"""From the many small files of the ingest to hourly facts.

Each run takes the finished micro-batches that are not compacted yet, writes their accepted rows once, by day and
hour, and removes the batch folders. A run has its own folder, named by its last batch: repeated after a break it
replaces its own output, and batches that an earlier run has already stored are only removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantpulse.plans.router import Tables
from plantpulse.schemas import METRIC_MAP, READINGS
from plantpulse.session import folder_names, path_exists, remove_path
from plantpulse.sinks.tables import gathered, with_partitions
from plantpulse.streaming.ingest import batch_folder

_FACTS = T.StructType([*READINGS.fields, T.StructField("metrics", METRIC_MAP), T.StructField("upto", T.LongType()),
                       T.StructField("dt", T.StringType()), T.StructField("hr", T.StringType())])


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    if not path_exists(spark, path):
        return []
    return sorted(int(n.removeprefix(prefix)) for n in folder_names(spark, path) if n.startswith(prefix))


def compacted_upto(spark: SparkSession, path: str) -> int:
    """Last batch of the last finished run, -1 before the first."""
    runs = [n for n in _numbers(spark, f"{path}/facts", "upto=") if path_exists(spark, f"{path}/facts/upto={n}/_SUCCESS")]
    return max(runs, default=-1)


def _finished(spark: SparkSession, path: str, after: int) -> list[int]:
    """Batches beyond a number whose counts are written."""
    return [n for n in _numbers(spark, f"{path}/rows", "batch_id=") if n > after and path_exists(spark, batch_folder(f"{path}/runs", n))]


def _accepted(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    schema = T.StructType([*READINGS.fields, T.StructField("metrics", METRIC_MAP), T.StructField("outcome", T.StringType()),
                           T.StructField("dt", T.StringType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(
        *[batch_folder(f"{path}/rows", n) for n in batches]).filter("outcome = 'accepted'")
    return rows.select(*READINGS.fieldNames(), "metrics", "dt")


def compact(spark: SparkSession, path: str, linger: bool = False) -> int:
    """Compact all finished batches; returns how many were taken. A batch is finished once its counts are written.

    With `linger` the batches of this run stay until the next run, so that a reader of `live_readings` that began
    before this run still finds its files.
    """
    done = compacted_upto(spark, path)
    batches = _numbers(spark, f"{path}/rows", "batch_id=")
    new = _finished(spark, path, done)
    if new:
        rows = with_partitions(_accepted(spark, path, new).drop("dt"))
        gathered(rows, "dt", "hr").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "dt", "hr").parquet(f"{path}/facts/upto={new[-1]}")
    for n in batches:
        if n <= (done if linger else max(done, *new, -1)):
            stored = f"{batch_folder(f'{path}/rows', n)}/outcome=accepted"
            if path_exists(spark, stored):  # the quarantine of the batch stays
                remove_path(spark, stored)
    return len(new)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Compacted readings with dt and hr; a bound on them reads only those folders."""
    return spark.read.schema(_FACTS).parquet(f"{path}/facts").drop("upto")


def live_readings(spark: SparkSession, path: str) -> DataFrame:
    """All accepted readings, compacted or not, with metrics, dt and hr; each is seen once.

    The number of the last finished run parts them: up to it the facts are read, beyond it the batches. Batches are
    listed before that number is read, so a compaction in between moves rows from one side to the other and neither
    doubles nor drops them. A bound on dt skips folders on both sides.
    """
    listed = _finished(spark, path, -1)
    runs = [n for n in _numbers(spark, f"{path}/facts", "upto=") if path_exists(spark, f"{path}/facts/upto={n}/_SUCCESS")]
    fresh = [n for n in listed if n > max(runs, default=-1)]
    columns = [*READINGS.fieldNames(), "metrics", "dt", "hr"]
    parts = []
    if runs:
        parts.append(spark.read.schema(_FACTS).option("basePath", f"{path}/facts").parquet(
            *[f"{path}/facts/upto={n}" for n in runs]).select(columns))
    if fresh:
        rows = _accepted(spark, path, fresh)
        parts.append(rows.withColumn("hr", F.date_format("event_time", "HH")).select(columns))
    if not parts:
        return spark.createDataFrame([], _FACTS).select(columns)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def live_tables(spark: SparkSession, path: str, robots: DataFrame, hourly: DataFrame | None = None) -> Tables:
    """What the router reads straight after ingest: both raw tiers are the live readings, pruned by day and hour."""
    rows = live_readings(spark, path)
    return Tables(recent=rows, facts=rows, robots=robots, hourly=hourly)
