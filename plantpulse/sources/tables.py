"""Batch readers: realtime rows, partitioned facts, rollup, dimensions, files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.functions.timefn import at
from plantpulse.schemas import READINGS

BROADCAST_IDS = 100_000


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None,
              lower: str | None = None, upper: str | None = None, partitions: int = 16,
              **options: str) -> DataFrame:
    """A database table, read by ranges of `key` in parallel when a key is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = (reader.option("partitionColumn", key).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", partitions))
    return reader.load()


def in_time_range(df: DataFrame, start: datetime, end: datetime, time: str = "event_time") -> DataFrame:
    """Rows with start <= time <= end. On a table partitioned by `dt` (and `hr`) only the days (and,
    within one day, hours) in range are read: a predicate on the time alone would not prune partitions."""
    kept = since_until(df, start, end, time)
    if "dt" in df.columns:
        if "hr" in df.columns and start.date() == end.date():
            kept = kept.filter(F.col("hr").cast("int").between(start.hour, end.hour))
    return kept


def since_until(df: DataFrame, start: datetime | None = None, end: datetime | None = None, time: str = "event_time",
                before: datetime | None = None) -> DataFrame:
    """Rows with start <= time <= end and time < before, each bound optional. With a `dt` column only its days are read."""
    for bound, keeps, days in ((start, lambda c, b: c >= b, lambda c, b: c >= b), (end, lambda c, b: c <= b, lambda c, b: c <= b),
                               (before, lambda c, b: c < b, lambda c, b: c <= b)):
        if bound is not None:
            df = df.filter(keeps(F.col(time), at(bound)))
            if "dt" in df.columns:
                df = df.filter(days(F.col("dt").cast("string"), F.lit(f"{bound:%Y-%m-%d}")))
    return df


def with_ids(df: DataFrame, column: str, ids, listed: int = 1000) -> DataFrame:
    """Optional IN filter: None or an empty list keeps every row.

    Short lists become a pushed-down IN predicate, longer ones a semi join: by broadcast up to a
    known length, shuffled beyond.
    """
    ids = list(ids or [])
    if not ids:
        return df
    if len(ids) <= listed:
        return df.filter(F.col(column).isin(ids))
    wanted = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], [column])
    return df.join(F.broadcast(wanted) if len(ids) <= BROADCAST_IDS else wanted, column, "left_semi")


def csv_files(spark: SparkSession, path: str, before: datetime | None = None, schema=READINGS) -> DataFrame:
    """All `*.csv` below a path, optionally only files last changed before a moment."""
    reader = (spark.read.schema(schema).option("header", True)
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv"))
    if before is not None:
        reader = reader.option("modifiedBefore", before.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.csv(path)


def file_listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, modified, bytes of every file below a path; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.col("modificationTime").cast("timestamp_ntz").alias("modified"), F.col("length").alias("bytes"))
