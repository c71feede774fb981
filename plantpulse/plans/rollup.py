"""Hourly rollup: built from readings, re-aggregated for long ranges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.functions.metrics import distinct_known
from plantpulse.functions.timefn import truncated
from plantpulse.schemas import METRICS
from plantpulse.sources.tables import with_ids


def build_hourly(readings: DataFrame) -> DataFrame:
    """One row per day, hour, robot and sensor type.

    Sums and non-null counts are stored besides the averages, so that averages of longer ranges stay
    exact when metrics have gaps.
    """
    measures: list[Column] = []
    for m in METRICS:
        measures += [
            F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"cnt_{m}"),
            F.max(m).alias(f"max_{m}"), F.min(m).alias(f"min_{m}"),
        ]
    hour = truncated("event_time", "hour")
    grouped = readings.groupBy(hour.alias("hour"), "robot_id", "sensor_type").agg(
        *measures,
        F.count("*").alias("data_count"),
        F.count_if(~F.col("status").eqNullSafe("NORMAL")).alias("abnormal_count"),
    )
    per_metric = [
        c for m in METRICS
        for c in (F.col(f"sum_{m}"), F.col(f"cnt_{m}"),
                  F.try_divide(f"sum_{m}", f"cnt_{m}").alias(f"avg_{m}"),
                  F.col(f"max_{m}"), F.col(f"min_{m}"))
    ]
    return grouped.select(
        F.date_format("hour", "yyyy-MM-dd").alias("dt"), F.date_format("hour", "HH").alias("hr"),
        "robot_id", "sensor_type", *per_metric, "data_count", "abnormal_count")


def merged_columns(metrics) -> list[Column]:
    """Columns that answer a routed aggregate from rollup rows."""
    columns = []
    for m in distinct_known(metrics):
        columns += [
            F.try_divide(F.sum(f"sum_{m}"), F.sum(f"cnt_{m}")).alias(f"avg_{m}"),
            F.max(f"max_{m}").alias(f"max_{m}"), F.min(f"min_{m}").alias(f"min_{m}"),
        ]
    return columns


def from_hourly(hourly: DataFrame, start: datetime, end: datetime, metrics,
                robot_ids=None, sensor_types=None) -> DataFrame:
    """Per-robot answer from the rollup. Bounds are whole days, both included."""
    rows = hourly.filter(F.col("dt").cast("string").between(f"{start:%Y-%m-%d}", f"{end:%Y-%m-%d}"))
    rows = with_ids(with_ids(rows, "robot_id", robot_ids), "sensor_type", sensor_types)
    return rows.groupBy("robot_id").agg(
        *merged_columns(metrics), F.sum("data_count").alias("data_count"))
