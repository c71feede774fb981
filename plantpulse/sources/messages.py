"""Readings as topic messages and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from plantpulse.functions.metrics import metric_map, metric_value
from plantpulse.functions.text import topic_of
from plantpulse.schemas import READING_EVENT

_CORRUPT = "_corrupt"
_METRIC_COLUMNS = ("temperature", "humidity", "pressure", "position_x", "position_y", "position_z")


def to_events(readings: DataFrame, *metrics: str, keep_nulls: bool = False) -> DataFrame:
    """Wide rows in message form. `keep_nulls` keeps missing metrics as keys without a value."""
    names = metrics or tuple(m for m in _METRIC_COLUMNS if m in readings.columns)
    return readings.select(
        "data_id", "robot_id", "sensor_id", "sensor_type", "event_time",
        metric_map(*names, keep_nulls=keep_nulls).alias("metrics"), "status")


def to_readings(events: DataFrame, *more: str) -> DataFrame:
    """Message form to wide rows; a metric the message lacks becomes NULL. `more` columns are kept, such as the
    whole `metrics` map, which alone holds metrics without a column."""
    return events.select(
        "data_id", "event_time", "robot_id", "sensor_id", "sensor_type",
        *[metric_value("metrics", m).alias(m) for m in _METRIC_COLUMNS], "status", *more)


def topic_rows(events: DataFrame) -> DataFrame:
    """topic, key, value columns as the Kafka sink takes them."""
    return events.select(
        topic_of("sensor_type").alias("topic"),
        F.concat_ws("#", "robot_id", "sensor_id").alias("key"),
        as_json(*events.columns).alias("value"))


def as_json(*columns: str):
    """JSON object of some columns; times keep their microseconds."""
    return F.to_json(F.struct(*columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to message columns, plus the text itself and why it could not be read.

    Malformed text keeps its row with `parse_error` set, for the quarantine.
    """
    text = F.col(value).cast("string")
    schema = T.StructType([*READING_EVENT.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = messages.select(text.alias("raw"), F.from_json(text, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("event"))
    broken = F.when(F.col("event").isNull() | F.col(f"event.{_CORRUPT}").isNotNull(), "not JSON")
    return parsed.select("raw", broken.alias("parse_error"), *[f"event.{f.name}" for f in READING_EVENT.fields])
