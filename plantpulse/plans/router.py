"""One entry for time-ranged per-robot aggregates; the length of the range picks the table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from plantpulse.functions.metrics import routed_columns, routed_names
from plantpulse.functions.timefn import as_moment
from plantpulse.functions.validate import ROBOT_ID, SENSOR_TYPE
from plantpulse.plans.rollup import from_hourly
from plantpulse.schemas import ALLOWED_METRICS, METRICS, ROLLUP_METRICS
from plantpulse.sources.tables import in_time_range, with_ids

# Longest spans of the first two tiers.
REALTIME_SPAN = timedelta(minutes=5)
INCREMENTAL_SPAN = timedelta(minutes=1440)


@dataclass
class Tables:
    """What the router may read. `recent` and `facts` have the reading columns."""

    recent: DataFrame
    facts: DataFrame
    robots: DataFrame
    hourly: DataFrame | None = None


def check_arguments(start, end, robot_ids=None, sensor_types=None, metrics=None) -> tuple[datetime, datetime]:
    start, end = as_moment(start), as_moment(end)
    for m in metrics or []:
        if m.lower() not in ALLOWED_METRICS:
            raise ValueError(f"metric not allowed: {m}")
    for r in robot_ids or []:
        if not re.fullmatch(ROBOT_ID, r):
            raise ValueError(f"robot id not allowed: {r}")
    for s in sensor_types or []:
        if not re.fullmatch(SENSOR_TYPE, s):
            raise ValueError(f"sensor type not allowed: {s}")
    return start, end


def tier_of(start: datetime, end: datetime, metrics) -> str:
    span = end - start
    if span < timedelta(0):
        return "empty"
    if span <= REALTIME_SPAN:
        return "realtime"
    if span <= INCREMENTAL_SPAN:
        return "incremental"
    wanted = [m.lower() for m in metrics or []]
    return "rollup" if wanted and all(m in ROLLUP_METRICS for m in wanted) else "fallback"


def _selected(readings, start, end, robot_ids, sensor_types):
    rows = in_time_range(readings, start, end)
    return with_ids(with_ids(rows, "robot_id", robot_ids), "sensor_type", sensor_types)


def incremental(readings: DataFrame, start, end, metrics=METRICS, robot_ids=None, sensor_types=None) -> DataFrame:
    """Per-robot aggregate of the readings alone."""
    rows = _selected(readings, start, end, robot_ids, sensor_types)
    return rows.groupBy("robot_id").agg(*routed_columns(metrics), F.count("*").alias("data_count"))


def realtime(readings: DataFrame, robots: DataFrame, start, end, metrics=METRICS,
             robot_ids=None, sensor_types=None) -> DataFrame:
    """Per-robot aggregate with name and type; robots without a dimension row drop out.

    Readings are aggregated before the join, so the join moves one row per robot, and the dimension
    is broadcast or shuffled as its size demands.
    """
    summed = incremental(readings, start, end, metrics, robot_ids, sensor_types)
    named = robots.select("robot_id", "robot_name", "robot_type")
    return summed.join(named, "robot_id").select(
        "robot_id", "robot_name", "robot_type", *routed_names(metrics), "data_count")


def route_query(tables: Tables, start, end, robot_ids=None, sensor_types=None, metrics=None,
                ordered: bool = True) -> DataFrame:
    """Validate, pick the tier, aggregate per robot, order by robot.

    Spans up to five minutes read the recent table and carry name and type; up to a day the facts;
    longer ones the rollup when only temperature and humidity are asked for, else the facts. A
    reversed range gives no rows.
    """
    start, end = check_arguments(start, end, robot_ids, sensor_types, metrics)
    tier = tier_of(start, end, metrics)
    if tier == "empty":
        return incremental(tables.facts, start, end, metrics, robot_ids, sensor_types).filter(F.lit(False))
    if tier == "realtime":
        out = realtime(tables.recent, tables.robots, start, end, metrics, robot_ids, sensor_types)
    elif tier == "rollup" and tables.hourly is not None:
        out = from_hourly(tables.hourly, start, end, metrics, robot_ids, sensor_types)
    else:
        out = incremental(tables.facts, start, end, metrics, robot_ids, sensor_types)
    return out.orderBy("robot_id") if ordered else out

