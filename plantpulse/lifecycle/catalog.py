"""Table catalogue: listing, description and partition maintenance, with name checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from plantpulse.sinks.tables import checked_name

_VALUE = re.compile(r"[A-Za-z0-9_.:-]+")


def tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select("tableName", "isTemporary")


def partitions(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {checked_name(table)}")


def describe(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE {checked_name(table)}")


def create_external(spark: SparkSession, table: str, schema, path: str, partitioned_by: list[str] = (),
                    fmt: str = "parquet") -> None:
    """A table over an existing folder."""
    columns = ", ".join(f"{checked_name(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    parts = f" PARTITIONED BY ({', '.join(map(checked_name, partitioned_by))})" if partitioned_by else ""
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {checked_name(table)} ({columns}) USING {checked_name(fmt)}"
              f"{parts} LOCATION '{where}'")


def _spec(values: dict[str, str]) -> str:
    for v in values.values():
        if not _VALUE.fullmatch(v):
            raise ValueError(f"partition value not allowed: {v}")
    return ", ".join(f"{checked_name(k)}='{v}'" for k, v in values.items())


def add_partition(spark: SparkSession, table: str, values: dict[str, str], path: str | None = None) -> None:
    where = " LOCATION '{}'".format(path.replace("'", "\\'")) if path else ""
    spark.sql(f"ALTER TABLE {checked_name(table)} ADD IF NOT EXISTS PARTITION ({_spec(values)}){where}")


def drop_partition(spark: SparkSession, table: str, values: dict[str, str]) -> None:
    spark.sql(f"ALTER TABLE {checked_name(table)} DROP IF EXISTS PARTITION ({_spec(values)})")


def repair(spark: SparkSession, table: str) -> None:
    """Register partition folders that were written without the catalogue."""
    spark.sql(f"MSCK REPAIR TABLE {checked_name(table)}")
