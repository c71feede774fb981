"""Time-bucket aggregates and trends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from plantpulse.functions.metrics import full_columns
from plantpulse.functions.timefn import bucket_label, bucket_start, interval_label, trend_label, truncated, widened
from plantpulse.schemas import AGGREGATE_FUNCTIONS, AGGREGATE_INTERVALS, METRICS
from plantpulse.sources.tables import in_time_range, with_ids


def bucket_aggregate(readings: DataFrame, start: datetime, end: datetime, kind: str = "minute",
                     robot_ids=None, ordered: bool = True) -> DataFrame:
    """Count, average, maximum and minimum of each metric per bucket and robot, newest bucket first.

    Groups by the bucket's start time and writes the text label afterwards, once per group.
    """
    rows = with_ids(in_time_range(readings, start, end), "robot_id", robot_ids)
    grouped = rows.groupBy(bucket_start("event_time", kind).alias("__start"), "robot_id").agg(
        F.count("*").alias("data_count"), *full_columns())
    out = grouped.select(bucket_label("__start", kind).alias("time_bucket"),
                         *[c for c in grouped.columns if c != "__start"])
    return out.orderBy(F.desc("time_bucket"), "robot_id") if ordered else out


def robot_cells(readings: DataFrame, interval: str) -> DataFrame:
    """Sums and counts per time bucket and robot: the one pass that trend and overview share."""
    return readings.groupBy(truncated("event_time", interval).alias("bucket"), "robot_id").agg(
        *[c for m in METRICS for c in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"cnt_{m}"))],
        F.count("*").alias("data_count"))


def trend_of_cells(cells: DataFrame, interval: str) -> DataFrame:
    """Mean over robots of their bucket averages. A robot without values in a bucket counts as 0."""
    grouped = cells.groupBy("bucket").agg(
        *[F.avg(F.coalesce(F.try_divide(f"sum_{m}", f"cnt_{m}"), F.lit(0.0))).alias(m) for m in METRICS],
        F.sum("data_count").alias("data_count"))
    return grouped.select(trend_label("bucket", interval).alias("time_label"), *METRICS, "data_count")


def trend(readings: DataFrame, start: datetime, end: datetime, interval: str = "hour", robot_ids=None) -> DataFrame:
    """Trend over the range widened by ten units before and one after."""
    low, high = widened(start, end, interval)
    rows = with_ids(in_time_range(readings, low, high), "robot_id", robot_ids)
    return trend_of_cells(robot_cells(rows, interval), interval)


_FUNCTIONS = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "stddev": F.stddev_pop}


def aggregate(readings: DataFrame, metric: str, functions=AGGREGATE_FUNCTIONS, interval: str = "hour",
              by: list[str] = ()) -> DataFrame:
    """Any supported functions of one metric per minute, hour, day, week or month."""
    if interval not in AGGREGATE_INTERVALS:
        raise ValueError(f"interval not supported: {interval}")
    unknown = [f for f in functions if f not in _FUNCTIONS]
    if unknown or metric not in METRICS:
        raise ValueError(f"not supported: {unknown or metric}")
    grouped = readings.groupBy(truncated("event_time", interval).alias("__start"), *by).agg(
        *[_FUNCTIONS[f](metric).alias(f"{f}_value") for f in functions])
    return grouped.select(interval_label("__start", interval).alias("time_bucket"), *by,
                          *[f"{f}_value" for f in functions])
