"""Snapshots of tables with a manifest; restore verifies before it writes."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantpulse.functions.timefn import at
from plantpulse.schemas import MANIFEST
from plantpulse.sources.tables import file_listing

# Fixed value: days a backup is kept.
BACKUP_RETENTION_DAYS = 30


def table_checksum(df: DataFrame) -> DataFrame:
    """Row count and an order-free checksum. A sum, not an exclusive-or: equal rows would cancel."""
    digest = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("row_count"),
                  F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"))


def row_text(df: DataFrame, columns: list[str]):
    """A row as text that other engines can repeat: doubles as whole millionths, times as microseconds, NULL marked."""
    parts = []
    for c in columns:
        kind, column = df.schema[c].dataType, F.col(c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column * 1e6).cast("bigint")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            column = F.unix_micros(column.cast("timestamp"))
        parts.append(F.coalesce(column.cast("string"), F.lit("\\N")))
    return F.concat_ws("|", *parts)


def digest_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and summed digests per first hexadecimal digit of the row's MD5: a checksum other engines can repeat.

    All columns by default. Every row counts in the sum, so one changed value changes it.
    """
    row = F.md5(row_text(df, columns or df.columns))
    part = F.conv(F.substring(row, 2, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(F.substring(row, 1, 1).alias("digit")).agg(
        F.count("*").alias("row_count"), F.sum(part).cast("string").alias("digest"))


def incremental_delta(readings: DataFrame, since: datetime) -> DataFrame:
    """Rows with an event time after the last backup. Rows that arrive late are not among them, see `not_yet_saved`."""
    rows = readings.filter(F.col("event_time") > at(since))
    if "dt" in readings.columns:
        rows = rows.filter(F.col("dt").cast("string") >= f"{since:%Y-%m-%d}")
    return rows


def _identity(df: DataFrame, key: str):
    """The key of a row, or a digest of the row where it has none."""
    own = F.md5(row_text(df, [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]))
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), own)


def not_yet_saved(rows: DataFrame, saved: list[DataFrame], key: str = "data_id") -> DataFrame:
    """Rows whose key no earlier part of the backup holds, whatever their event time: late ones and those without one too."""
    known = None
    for part in saved:
        ids = part.select(_identity(part, key).alias("__id"))
        known = ids if known is None else known.unionByName(ids)
    if known is None:
        return rows
    return rows.withColumn("__id", _identity(rows, key)).join(known, "__id", "left_anti").drop("__id")


def _save(spark, name, df, path, kind, since, until):
    folder = f"{path}/{name}"
    df.write.mode("overwrite").parquet(folder)
    saved = spark.read.parquet(folder)  # the snapshot itself is summed, not a second run of the plan
    facts = table_checksum(saved).first()
    return (name, facts.row_count, facts.checksum, saved.schema.json(), kind, since, until)


def full_backup(spark: SparkSession, tables: dict[str, DataFrame], path: str, until: datetime) -> DataFrame:
    """Copy tables and write the manifest."""
    rows = [_save(spark, n, df, path, "FULL_BACKUP", None, until) for n, df in tables.items()]
    return _manifest(spark, rows, path)


def incremental_backup(spark: SparkSession, tables: dict[str, DataFrame], path: str,
                       since: datetime, until: datetime, earlier: list[str], key: str = "data_id") -> DataFrame:
    """Copy the rows that arrived since: those that no earlier part (paths of the full backup and increments) holds.

    `since` and `until` are noted in the manifest; they do not choose rows.
    """
    rows = []
    for name, df in tables.items():
        delta = not_yet_saved(df, [spark.read.parquet(f"{p}/{name}") for p in earlier], key)
        rows.append(_save(spark, name, delta, path, "INCREMENTAL_BACKUP", since, until))
    return _manifest(spark, rows, path)


def _manifest(spark, rows, path):
    manifest = spark.createDataFrame(rows, MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Per table: manifest and actual row count and checksum, and whether they agree."""
    out = None
    for m in read_manifest(spark, path).collect():
        schema = T.StructType.fromJson(json.loads(m.schema_json))
        actual = table_checksum(spark.read.schema(schema).parquet(f"{path}/{m.table_name}"))
        row = actual.select(
            F.lit(m.table_name).alias("table_name"), F.lit(m.row_count).alias("expected_rows"), "row_count",
            ((F.col("row_count") == m.row_count)
             & (F.col("checksum") == F.lit(str(m.checksum)).cast("decimal(38,0)"))).alias("intact"))
        out = row if out is None else out.unionByName(row)
    return out


def restored(spark: SparkSession, name: str, full: str, increments=()) -> DataFrame:
    """Full snapshot plus increments; an increment holds only what no earlier part does."""
    df = spark.read.parquet(f"{full}/{name}")
    for path in increments:
        df = df.unionByName(spark.read.parquet(f"{path}/{name}"))
    return df


def restore(spark: SparkSession, name: str, target: str, full: str, increments=(), overwrite: bool = False,
            dry_run: bool = False) -> DataFrame:
    """Verify all parts and, unless it is a dry run, write the table. Returns the check rows."""
    check = verify(spark, full)
    for path in increments:
        check = check.unionByName(verify(spark, path))
    check = check.filter(F.col("table_name") == name)
    bad = check.filter(~F.col("intact")).count()
    if bad:
        raise ValueError(f"{bad} part(s) of the backup of {name} do not match the manifest")
    if not dry_run:
        restored(spark, name, full, increments).write.mode(
            "overwrite" if overwrite else "errorifexists").parquet(target)
    return check


def same_content(a: DataFrame, b: DataFrame) -> bool:
    return table_checksum(a).first() == table_checksum(b).first()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of every file below a path, computed where the files are read (files below 2 GB)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", F.md5("content").alias("md5")))


def same_files(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Files of two folders by relative path, and whether their digests agree."""

    def relative(root):
        place = F.locate(root.rstrip("/"), F.col("path")) + len(root.rstrip("/"))
        name = F.substring(F.col("path"), place, F.length("path"))
        return file_digests(spark, root).select(name.alias("file"), "md5")

    left, right = relative(a).withColumnRenamed("md5", "a"), relative(b).withColumnRenamed("md5", "b")
    return left.join(right, "file", "full").select("file", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def expired_files(spark: SparkSession, path: str, before: datetime) -> DataFrame:
    """Backup files last changed before the cutoff."""
    return file_listing(spark, path).filter(F.col("modified") < at(before))


def expired_summary(spark: SparkSession, path: str, before: datetime) -> DataFrame:
    return expired_files(spark, path, before).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("freed_bytes"))
