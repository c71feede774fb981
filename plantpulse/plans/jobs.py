"""Scheduled jobs as plain functions; each rerun replaces what it wrote before."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, functions as F

from plantpulse.functions.metrics import full_columns
from plantpulse.functions.timefn import at, iso_week, truncated
from plantpulse.plans.rollup import build_hourly
from plantpulse.sinks.tables import gathered, overwrite_partitions
from plantpulse.sources.tables import since_until


def _day(readings: DataFrame, start: datetime, days: int) -> DataFrame:
    """Rows of whole days, the last one exclusive at midnight."""
    end = start + timedelta(days=days)
    return since_until(readings, start=start, before=end)


def daily_summary(readings: DataFrame, day: date | None = None) -> DataFrame:
    """Per day and robot: count, average, maximum and minimum of each metric.

    With a day only that day is read; without, every day of the table is summarised in one pass.
    """
    rows = readings if day is None else _day(readings, datetime.combine(day, time()), 1)
    return rows.groupBy(F.to_date("event_time").alias("dt"), "robot_id").agg(
        *full_columns(), F.count("*").alias("data_count"))


def weekly_report(readings: DataFrame, end: date) -> DataFrame:
    """One row for the seven days before `end`: ISO week, robots, readings, period text."""
    first = datetime.combine(end, time()) - timedelta(days=7)
    rows = _day(readings, first, 7)
    per_robot = rows.groupBy("robot_id").agg(F.count("*").alias("n"))
    last = first + timedelta(days=6)
    return per_robot.agg(
        F.count("*").alias("total_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("data_count"),
    ).select(
        iso_week(at(last)).alias("week"), "total_records", "data_count",
        F.lit(f"{first:%Y-%m-%d} - {last:%Y-%m-%d}").alias("period"))


def weekly_reports(readings: DataFrame) -> DataFrame:
    """The weekly figures for every ISO week of the table."""
    per_robot = readings.groupBy(truncated("event_time", "week").alias("monday"),
                                 "robot_id").agg(F.count("*").alias("n"))
    weeks = per_robot.groupBy("monday").agg(
        F.count("*").alias("total_records"), F.sum("n").alias("data_count"))
    label = "yyyy-MM-dd"
    return weeks.select(
        iso_week("monday").alias("week"), "total_records", "data_count",
        F.concat_ws(" - ", F.date_format("monday", label),
                    F.date_format(F.col("monday") + F.expr("INTERVAL '6' DAY"), label)).alias("period"))


def run_daily(readings: DataFrame, day: date, target: str) -> None:
    """Write the summary of one day; a second run replaces the day, also when nothing of it is left."""
    _replace_day(daily_summary(readings, day), target, day)


def run_hourly_rollup(readings: DataFrame, day: date, target: str) -> None:
    """Rebuild the rollup rows of one day."""
    rows = _day(readings, datetime.combine(day, time()), 1)
    _replace_day(build_hourly(rows), target, day)


def _replace_day(rows: DataFrame, target: str, day: date) -> None:
    """Write the folder of the day itself: a dynamic overwrite without rows would leave the old ones."""
    gathered(rows.drop("dt")).write.mode("overwrite").parquet(f"{target}/dt={day:%Y-%m-%d}")


def store_hourly_rollup(readings: DataFrame, target: str) -> None:
    """Build the rollup of all days at once, partitioned by day."""
    overwrite_partitions(build_hourly(readings), target, ["dt"])
