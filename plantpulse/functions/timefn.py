"""Time labels, bucket keys and calendar expressions (all zone-free timestamps)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.functions.columns import as_col

TIME_TEXT = "yyyy-MM-dd HH:mm:ss"

# Label patterns per interval.
_BUCKET_LABELS = {
    "minute": "yyyy-MM-dd HH:mm:00",
    "hourly": "yyyy-MM-dd HH:00:00",
    "daily": "yyyy-MM-dd",
}
_TREND_LABELS = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}
_PARTITION_LABELS = {"daily": "yyyy-MM-dd", "hourly": "yyyy-MM-dd-HH", "monthly": "yyyy-MM"}
_STEP = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1)}


def truncated(time, unit: str) -> Column:
    """Start of the second, minute, hour, day, week or month. Works on the wall clock alone, whatever
    the session zone, and yields a long-backed key that groups faster than a text label."""
    t = as_col(time)
    day = F.to_date(t)
    if unit in ("week", "month"):
        return F.trunc(day, unit).cast("timestamp_ntz")
    whole = {
        "day": F.lit(0), "hour": F.hour(t) * 3600, "minute": F.hour(t) * 3600 + F.minute(t) * 60,
        "second": F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t),
    }[unit]
    return day.cast("timestamp_ntz") + F.expr("INTERVAL '1' SECOND") * whole


def iso_week(time) -> Column:
    """ISO year and week, `2024-05`."""
    time = as_col(time)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), time).cast("string"),
        F.lit("-"),
        F.lpad(F.weekofyear(time).cast("string"), 2, "0"),
    )


def week_monday_first(day) -> Column:
    """Week number 0..53, weeks start on Monday, week 1 is the first with four or more days."""
    day = as_col(day).cast("date")
    lead = F.weekday(F.trunc(day, "YEAR"))
    full = F.floor((F.dayofyear(day) - 1 + lead) / F.lit(7))
    return (full + F.when(lead <= 3, 1).otherwise(0)).cast("int")


def bucket_start(time, kind: str) -> Column:
    """Start of the bucket that `bucket_label` names; unknown kinds are minutes."""
    unit = {"hourly": "hour", "daily": "day", "weekly": "week"}.get(kind.lower(), "minute")
    return truncated(time, unit)


def bucket_label(start, kind: str) -> Column:
    kind = kind.lower()
    if kind == "weekly":
        return iso_week(start)
    return F.date_format(as_col(start), _BUCKET_LABELS.get(kind, _BUCKET_LABELS["minute"]))


def trend_label(start, interval: str) -> Column:
    return F.date_format(as_col(start), _TREND_LABELS[interval])


def interval_label(start, interval: str) -> Column:
    """Labels of the generic aggregate: minute, hour, day, week, month."""
    if interval == "week":
        return iso_week(start)
    pattern = {**_TREND_LABELS, "month": "yyyy-MM"}[interval]
    return F.date_format(as_col(start), pattern)


def partition_value(time, kind: str = "daily") -> Column:
    return F.date_format(as_col(time), _PARTITION_LABELS.get(kind.lower(), _PARTITION_LABELS["daily"]))


def parse_strict(text) -> Column:
    """`yyyy-MM-dd HH:mm:ss` or NULL."""
    return F.try_to_timestamp(as_col(text), F.lit(TIME_TEXT)).cast("timestamp_ntz")


def seconds_between(start, end) -> Column:
    """Whole seconds from start to end, by the wall clock."""
    return (as_col(end) - as_col(start)).cast("interval second").cast("bigint")


def time_attributes(moments: DataFrame, time: str = "moment") -> DataFrame:
    """The columns of the time dimension for a table of moments."""
    t = F.col(time)
    return moments.select(
        F.date_format(t, "yyyyMMddHHmmss").cast("bigint").alias("time_key"), F.to_date(t).alias("full_date"),
        F.year(t).alias("year"), F.month(t).alias("month"), F.day(t).alias("day"),
        F.hour(t).alias("hour"), F.minute(t).alias("minute"),
        week_monday_first(t).alias("week_of_year"), F.dayofweek(t).alias("day_of_week"),
        F.dayofweek(t).isin(1, 7).alias("is_weekend"), F.quarter(t).alias("quarter"))


def time_dimension(readings: DataFrame, time: str = "event_time") -> DataFrame:
    """The minutes in which there are readings."""
    return time_attributes(readings.select(truncated(time, "minute").alias("moment")).distinct())


def minutes_from(spark: SparkSession, start: datetime, count: int, last: datetime | None = None) -> DataFrame:
    """The time dimension for `count` minutes from a start, none after `last`."""
    step = F.make_dt_interval(mins=F.col("id").cast("int"))
    moments = spark.range(count).select((at(start) + step).alias("moment"))
    return time_attributes(moments if last is None else moments.filter(F.col("moment") <= at(last)))


def epoch_seconds(time) -> Column:
    """Seconds since 1970 by the wall clock."""
    t = as_col(time)
    return (F.unix_date(F.to_date(t)).cast("bigint") * 86400
            + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))


def at(moment: datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def as_moment(value) -> datetime:
    """Router arguments: a datetime, or text that must have the documented form."""
    if isinstance(value, datetime):
        return value
    if value is None:
        raise ValueError("time arguments must not be empty")
    try:
        parsed = datetime.strptime(value, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        raise ValueError(f"time must look like yyyy-MM-dd HH:mm:ss: {value!r}") from None
    if len(value) != 19:
        raise ValueError(f"time must look like yyyy-MM-dd HH:mm:ss: {value!r}")
    return parsed


def widened(start: datetime, end: datetime, interval: str, before: int = 10, after: int = 1):
    """The range a trend reads: ten units earlier, one unit later; unknown units leave it as it is."""
    step = _STEP.get(interval)
    if step is None:
        return start, end
    return start - before * step, end + after * step
