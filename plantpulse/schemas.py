"""Canonical schemas and the fixed value lists of the telemetry model."""

from __future__ import annotations

from pyspark.sql import types as T

# Metrics a query may name, in the order they are reported.
METRICS = ("temperature", "humidity", "pressure")
ALLOWED_METRICS = ("temperature", "humidity", "pressure", "light", "noise")
ROLLUP_METRICS = ("temperature", "humidity")

# Enumerations.
SENSOR_TYPES = ("TEMPERATURE", "HUMIDITY", "PRESSURE", "POSITION", "VIBRATION", "NOISE")
ROBOT_TYPES = ("WELDING", "ASSEMBLY", "TRANSPORT")
COMMAND_STATUSES = ("PENDING", "EXECUTED", "FAILED", "RETRYING", "CANCELLED")
SEVERITIES = ("NORMAL", "MEDIUM", "HIGH", "CRITICAL")
DATA_TAGS = ("realtime", "batch", "anomaly", "critical", "processed", "raw")
AGGREGATE_FUNCTIONS = ("avg", "max", "min", "sum", "count", "stddev")
AGGREGATE_INTERVALS = ("minute", "hour", "day", "week", "month")

# Kafka topics.
TOPIC_PREFIX = "sensor-data-"
TOPIC_PATTERN = "sensor-data-.*"
DEFAULT_TOPICS = ("sensor-data-temperature", "sensor-data-humidity", "sensor-data-pressure")
KNOWN_TOPICS = tuple(TOPIC_PREFIX + t.lower() for t in SENSOR_TYPES) + (TOPIC_PREFIX + "general",)
MANUAL_TOPIC = "sensor-data-manual"
ERROR_TOPIC = "sensor-data-error"

_string, _double, _long, _int = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
_time, _date = T.TimestampNTZType(), T.DateType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LOCATION = _struct(("x", _double), ("y", _double), ("z", _double), ("coordinate_system", _string))
POSITION = _struct(("x", _double), ("y", _double), ("z", _double), ("rotation", _double))
METRIC_MAP = T.MapType(_string, _double)

# One sensor message as it travels on a topic: open metric map, nested location.
READING_EVENT = _struct(
    ("data_id", _string), ("robot_id", _string), ("sensor_id", _string), ("sensor_type", _string),
    ("event_time", _time), ("metrics", METRIC_MAP), ("location", LOCATION),
    ("status", _string), ("valid", T.BooleanType()),
)

READINGS = _struct(
    ("data_id", _string), ("event_time", _time), ("robot_id", _string), ("sensor_id", _string),
    ("sensor_type", _string), ("temperature", _double), ("humidity", _double), ("pressure", _double),
    ("position_x", _double), ("position_y", _double), ("position_z", _double), ("status", _string),
)

DIM_ROBOT = _struct(
    ("robot_id", _string), ("robot_name", _string), ("robot_type", _string), ("model", _string),
    ("production_date", _date), ("location", _string), ("department", _string),
    ("responsible_user", _string), ("create_time", _time), ("update_time", _time), ("status", _int),
)

DIM_SENSOR = _struct(
    ("sensor_id", _string), ("sensor_name", _string), ("sensor_type", _string), ("manufacturer", _string),
    ("model", _string), ("accuracy", T.DecimalType(5, 2)), ("measurement_range", _string),
    ("calibration_date", _date), ("status", _int), ("create_time", _time), ("update_time", _time),
)

ROBOT_STATUS = _struct(
    ("robot_id", _string), ("robot_name", _string), ("robot_type", _string), ("status", _string),
    ("position", POSITION), ("task_status", _string), ("current_task_id", _string),
    ("battery_level", _double), ("temperature", _double), ("error_code", _string),
    ("error_description", _string), ("sensor_data", METRIC_MAP), ("last_update_time", _time),
)

ROBOT_COMMAND = _struct(
    ("command_id", _string), ("robot_id", _string), ("command_type", _string), ("parameters", _string),
    ("priority", _int), ("status", _string), ("create_time", _time), ("execute_time", _time),
    ("complete_time", _time), ("error_message", _string), ("result", _string),
    ("retry_count", _int), ("max_retry", _int), ("timeout", _int),
)

ALERT_RULE = _struct(
    ("rule_id", _string), ("rule_name", _string), ("rule_type", _string), ("description", _string),
    ("conditions", _string), ("actions", _string), ("severity", _string), ("enable_flag", _int),
)

ALERT_CONDITION = _struct(
    ("metric", _string), ("operator", _string), ("threshold", _double), ("duration", _long),
)

SUBSCRIPTION = _struct(
    ("subscription_id", _string), ("callback_url", _string),
    ("robot_ids", T.ArrayType(_string)), ("sensor_types", T.ArrayType(_string)),
)

BACKUP_TASK = _struct(
    ("task_id", _string), ("task_type", _string), ("status", _string), ("start_time", _time),
    ("end_time", _time), ("backup_size", _long), ("file_count", _long),
)

COMPRESSION_TASK = _struct(
    ("task_id", _string), ("status", _string), ("total_files", _long), ("compressed_files", _long),
    ("original_size", _long), ("compressed_size", _long), ("compression_algorithm", _string),
)

MANIFEST = _struct(
    ("table_name", _string), ("row_count", _long), ("checksum", T.DecimalType(38, 0)),
    ("schema_json", _string), ("kind", _string), ("since", _time), ("until", _time),
)

# Seed rules: conditions carry the operator as a JSON escape, as stored.
SEED_RULES = [
    ("RULE001", "high temperature", "TEMPERATURE", "robot temperature above 80 degrees",
     '{"metric": "temperature", "operator": "\\u003e", "threshold": 80, "duration": 300}',
     '{"type": "webhook"}', "HIGH", 1),
    ("RULE002", "low battery", "BATTERY", "robot battery below 10 percent",
     '{"metric": "battery_level", "operator": "\\u003c", "threshold": 10, "duration": 60}',
     '{"type": "email"}', "CRITICAL", 1),
]
