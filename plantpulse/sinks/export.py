"""Exports of routed rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

# Export columns in file order, and their headings.
EXPORT_COLUMNS = (
    "robot_id", "robot_name", "robot_type",
    "avg_temperature", "max_temperature", "min_temperature",
    "avg_humidity", "max_humidity", "min_humidity",
    "avg_pressure", "data_count",
)
HEADINGS = ("机器人ID", "机器人名称", "机器人类型", "平均温度", "最高温度", "最低温度",
            "平均湿度", "最高湿度", "最低湿度", "平均压力", "数据量")
CONTENT_TYPES = {
    "csv": "text/csv", "json": "application/json",
    "excel": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def export_rows(routed: DataFrame) -> DataFrame:
    """The eleven export columns; those the tier does not deliver are NULL."""
    have = set(routed.columns)
    return routed.select(*[
        F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXPORT_COLUMNS])


def content_type(kind: str) -> str:
    return CONTENT_TYPES.get(kind.lower(), "application/octet-stream")


def file_name(start: datetime, end: datetime, kind: str) -> str:
    return f"sensor_data_{start:%Y%m%d%H%M%S}_{end:%Y%m%d%H%M%S}.{kind}"


def export(routed: DataFrame, path: str, kind: str, exported_at: datetime) -> None:
    """Write csv, json or excel (which is csv). Rows are written by all tasks in parallel.

    JSON goes to `rows` as lines, next to `header` with export time and row count.
    """
    kind = kind.lower()
    if kind in ("csv", "excel"):
        rows = export_rows(routed)
        titled = rows.select(*[F.col(c).alias(h) for c, h in zip(EXPORT_COLUMNS, HEADINGS)])
        titled.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")
    elif kind == "json":
        routed.write.mode("overwrite").json(f"{path}/rows")
        export_header(routed, exported_at).write.mode("overwrite").json(f"{path}/header")
    else:
        raise ValueError(f"format not supported: {kind}")


def export_header(routed: DataFrame, exported_at: datetime) -> DataFrame:
    return routed.agg(F.count("*").alias("total_records")).select(
        F.lit(f"{exported_at:%Y-%m-%d %H:%M:%S}").alias("export_time"), "total_records")
