"""Row-level queries: newest rows, ranges, pages, latest per robot, samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.operators.ordered import rows_at, total_order, with_row_index
from plantpulse.operators.positions import MOST_RANGES
from plantpulse.sources.tables import in_time_range, with_ids

# Up to this many leading rows Spark keeps a bounded heap per task; beyond, rows are numbered. Both ways sort by the
# same total order, so the answer does not depend on it.
HEAP_ROWS = 100_000


def newest(readings: DataFrame, n: int, robot_ids=None, sensor_types=None, columns: list[str] | None = None) -> DataFrame:
    """The n newest readings; only the given columns are read (and decide what ties), if they are named."""
    rows = with_ids(with_ids(readings, "robot_id", robot_ids), "sensor_type", sensor_types)
    rows = rows.select(*dict.fromkeys([*columns, "event_time", "data_id"])) if columns else rows
    return first_rows(rows, ["event_time", "data_id"], n, descending=True)


def first_rows(df: DataFrame, order: list[str], n: int, descending: bool = False) -> DataFrame:
    """The first n rows of an order; NULLs and repeated keys have their fixed place."""
    if n <= HEAP_ROWS:
        return df.orderBy(*total_order(df, order, descending)).limit(n)
    return rows_at(df, order, lambda _: [(0, n - 1)], descending)[0]


def time_range(readings: DataFrame, start: datetime, end: datetime, robot_ids=None, sensor_types=None,
               ordered: bool = True) -> DataFrame:
    """All readings of a range, newest first."""
    rows = in_time_range(readings, start, end)
    rows = with_ids(with_ids(rows, "robot_id", robot_ids), "sensor_type", sensor_types)
    return rows.orderBy(F.desc("event_time"), F.desc("data_id")) if ordered else rows


def page(df: DataFrame, order: list[str], number: int, size: int, first_page: int = 1,
         descending: bool = False) -> DataFrame:
    """One page plus the columns `total` and `pages`; past the end it has no rows.

    Early pages come from a bounded sort. Deep ones would make every task keep all rows up to the
    offset, so there ranges of the order are counted and the page is picked by position: the same rows.
    """
    skip = (number - first_page) * size
    if skip + size > HEAP_ROWS:
        return page_by_position(df, order, number, size, first_page, descending)
    rows = df.orderBy(*total_order(df, order, descending)).offset(skip).limit(size)
    return _with_totals(rows, df.agg(F.count("*")).scalar(), size)


def page_by_position(df: DataFrame, order: list[str], number: int, size: int, first_page: int = 1,
                     descending: bool = False) -> DataFrame:
    """The same page, found by counting ranges of the order; its cost does not grow with the offset."""
    skip = (number - first_page) * size
    rows, total = rows_at(df, order, lambda _: [(skip, skip + size - 1)], descending)
    return _with_totals(rows, F.lit(total), size)


def _with_totals(rows: DataFrame, count, size: int) -> DataFrame:
    return rows.withColumn("total", count.cast("bigint")).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(size)).cast("bigint"))


def page_summary(df: DataFrame, size: int) -> DataFrame:
    """total and pages alone, one row; also answers for a page past the end."""
    return df.agg(F.count("*").alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(size)).cast("bigint"))


def next_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The page behind a known last key: constant cost at any depth."""
    if after is not None:
        last = F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, after)])
        # the plain bound on the leading column is what the scan can use to skip data
        df = df.filter((F.col(order[0]) >= last[order[0]]) & (F.struct(*order) > last))
    return df.orderBy(*order).limit(size)


def latest_per_robot(readings: DataFrame, key: str = "robot_id", time: str = "event_time") -> DataFrame:
    """Newest reading of each robot, ties kept.

    `rank <= 1` lets Spark drop the older rows inside each map task, before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(F.desc(time))
    return readings.withColumn("__rank", F.rank().over(w)).filter(F.col("__rank") <= 1).drop("__rank")


def robot_sensor_latest(status: DataFrame, robots: DataFrame, readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Robot state with its newest readings, robot location and sensor names.

    Robots without any reading drop out, readings of an unknown sensor keep NULL names.
    """
    last = latest_per_robot(readings).select(
        "robot_id", "sensor_id", "humidity", "pressure",
        F.col("temperature").alias("sensor_temperature"), F.col("event_time").alias("last_sensor_time"))
    state = status.select("robot_id", "robot_name", "robot_type", "status", "battery_level",
                          F.col("temperature").alias("robot_temperature"))
    named = sensors.select("sensor_id", "sensor_name", "sensor_type")
    return (
        last.join(state, "robot_id")
        .join(robots.select("robot_id", "location"), "robot_id", "left")
        .join(named, "sensor_id", "left")
        .select("robot_id", "robot_name", "robot_type", "status", "location", "battery_level",
                "robot_temperature", "sensor_id", "sensor_name", "sensor_type",
                "sensor_temperature", "humidity", "pressure", "last_sensor_time")
    )


def sample_random(df: DataFrame, n: int, seed: int = 0, key: str = "data_id") -> DataFrame:
    """Exactly n rows at random, all rows when there are no more than n.

    The draw is the MD5 of seed and row key, so a recomputed task, or another engine, draws the same rows.
    """
    drawn = df.withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    return first_rows(drawn, ["__draw", key], n).drop("__draw")


def sample_systematic(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every step-th row, step = floor(total / n), until n rows; all rows when there are no more than n."""

    def chosen(total):
        step = total // n if total > n else 1
        return [(i * step, i * step) for i in range(min(n, total))]

    if n > MOST_RANGES:
        numbered, total = with_row_index(df, total_order(df, order), "__at")
        step = total // n if total > n else 1
        return numbered.filter((F.col("__at") % step == 0) & (F.col("__at") < step * n)).drop("__at")
    return rows_at(df, order, chosen)[0]


def sample_head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows."""
    return first_rows(df, order, n)


def sample(df: DataFrame, n: int, method: str, order: list[str], key: str = "data_id", seed: int = 0) -> DataFrame:
    if method == "random":
        return sample_random(df, n, seed, key)
    if method == "systematic":
        return sample_systematic(df, order, n)
    return sample_head(df, order, n)


def sensor_types(readings: DataFrame) -> DataFrame:
    """Sensor types that occur."""
    return readings.select("sensor_type").distinct()
