"""Row validators. Each is a column expression, so whole tables are screened in one scan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plantpulse.functions.columns import as_col, finite, not_blank

# Inclusive ranges of the stream validator, and the identifier patterns.
METRIC_RANGES = {"temperature": (-50.0, 150.0), "humidity": (0.0, 100.0), "pressure": (500.0, 1500.0)}
ROBOT_ID = "^[A-Z0-9_#-]+$"
SENSOR_TYPE = "^[A-Z_]+$"
TABLE_NAME = "^[a-zA-Z_][a-zA-Z0-9_]*$"


def stream_reason(metrics="metrics", time="event_time") -> Column:
    """Why the stream rejects a row, NULL when it is accepted.

    A metric that is absent passes; one that is present but NULL or outside its
    range does not.
    """
    metrics = as_col(metrics)
    reason = F.lit(None).cast("string")
    for name, (low, high) in reversed(METRIC_RANGES.items()):
        value = F.try_element_at(metrics, F.lit(name))
        inside = F.coalesce(value.between(low, high) & ~F.isnan(value), F.lit(False))
        present = F.coalesce(F.map_contains_key(metrics, F.lit(name)), F.lit(False))
        reason = F.when(present & ~inside, F.lit(f"{name} out of range")).otherwise(reason)
    for name in (time, "sensor_type", "sensor_id", "robot_id", "data_id"):
        reason = F.when(F.col(name).isNull(), F.lit(f"{name} missing")).otherwise(reason)
    return reason


def stream_valid(metrics="metrics", time="event_time") -> Column:
    return stream_reason(metrics, time).isNull()


def all_finite(metrics) -> Column:
    """No metric is NULL, NaN or infinite; a missing map passes."""
    metrics = as_col(metrics)
    return F.coalesce(F.forall(F.map_values(metrics), finite), F.lit(True))


def http_valid(metrics="metrics") -> Column:
    """Identifiers filled in, every metric a finite number."""
    return not_blank("robot_id") & not_blank("sensor_id") & not_blank("sensor_type") & all_finite(metrics)


def entity_valid(metrics="metrics", flag="valid") -> Column:
    """The entity's own check: at least one metric, all finite, and its valid flag set."""
    filled = F.coalesce(F.size(as_col(metrics)) > 0, F.lit(False))
    return filled & all_finite(metrics) & F.coalesce(as_col(flag), F.lit(False))


def robot_id_ok(c) -> Column:
    return F.coalesce(as_col(c).rlike(ROBOT_ID), F.lit(False))


def sensor_type_ok(c) -> Column:
    return F.coalesce(as_col(c).rlike(SENSOR_TYPE), F.lit(False))


def table_name_ok(c) -> Column:
    return F.coalesce(as_col(c).rlike(TABLE_NAME), F.lit(False))
