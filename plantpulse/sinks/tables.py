"""Partitioned and bucketed tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from plantpulse.functions.validate import TABLE_NAME

# Partition columns per strategy, and the layout of fact and rollup tables.
STRATEGIES = {
    "DAILY": ["dt"], "HOURLY": ["dt", "hr"], "ROBOT": ["robot_id"], "COMBINED": ["dt", "robot_id"],
}
FACT_BUCKETS, ROLLUP_BUCKETS = 32, 16


def checked_name(table: str) -> str:
    if not re.fullmatch(TABLE_NAME, table):
        raise ValueError(f"table name not allowed: {table}")
    return table


def with_partitions(readings: DataFrame, time: str = "event_time") -> DataFrame:
    """Adds dt and hr as text."""
    return readings.withColumns({
        "dt": F.date_format(time, "yyyy-MM-dd"), "hr": F.date_format(time, "HH")})


def gathered(df: DataFrame, *columns: str) -> DataFrame:
    """Bring the rows of a partition value together before a partitioned write.

    Without this every task writes a file into every partition. Adaptive execution splits a value that
    is too large for one task and merges small ones, so neither a busy day nor a quiet one hurts.
    """
    return df.hint("rebalance", *columns)


def append_readings(readings: DataFrame, path: str) -> None:
    """Append to a table partitioned by day."""
    rows = with_partitions(readings).drop("hr")
    gathered(rows, "dt").write.mode("append").partitionBy("dt").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """Replace only the partitions that the rows touch."""
    (gathered(df, *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*columns).format(fmt).save(path))


def save_fact_table(readings: DataFrame, table: str, strategy: str = "HOURLY", buckets: int = FACT_BUCKETS,
                    bucket_by: str = "robot_id", sort_by: str = "event_time", fmt: str = "orc",
                    codec: str = "zlib", path: str | None = None) -> None:
    """The history table: partitioned by strategy, bucketed by robot, sorted by time.

    Buckets spare aggregations and joins on the robot their shuffle. Rows are gathered by partition
    and bucket; a bucket too large for one task becomes several files of that bucket. A strategy that
    partitions by the bucket column itself is written without buckets.
    """
    columns = STRATEGIES[strategy]
    rows = with_partitions(readings).drop(*[c for c in ("dt", "hr") if c not in columns])
    if bucket_by in columns:
        writer = gathered(rows, *columns).sortWithinPartitions(*columns, sort_by).write
    else:
        marked = rows.withColumn("__bucket", F.pmod(F.hash(bucket_by), F.lit(buckets)))
        writer = gathered(marked, *columns, "__bucket").drop("__bucket").write.bucketBy(buckets, bucket_by).sortBy(sort_by)
    writer = writer.mode("overwrite").format(fmt).option("compression", codec).partitionBy(*columns)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(checked_name(table))


def write_summary(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Result tables (anomalies, quality, daily and hourly aggregates): rewritten per partition."""
    if by:
        overwrite_partitions(df, path, by)
    else:
        df.write.mode("overwrite").parquet(path)
