"""Rewriting old partitions with another codec."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantpulse.schemas import COMPRESSION_TASK
from plantpulse.session import folder_names, folder_size, make_folder, move_into, move_path, path_exists, remove_path
from plantpulse.sinks.tables import gathered
from plantpulse.sources.tables import file_listing

# Codecs by name, and the age after which data is compressed.
CODECS = {"GZIP": "gzip", "SNAPPY": "snappy", "LZ4": "lz4", "ZSTD": "zstd", "NONE": "none"}
COMPRESS_AFTER_DAYS = 30
# Folders of a rewrite in place. Spark's readers skip names that begin with an underscore.
RECODED, REPLACED = "_recoded", "_replaced"


def _size(spark: SparkSession, path: str, before: str) -> tuple[int, int]:
    day = F.regexp_extract("path", "dt=([^/]+)", 1)
    row = file_listing(spark, path, "*.parquet").filter((day != "") & (day < before)).agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    return row[0], row[1]


def rewrite(spark: SparkSession, source: str, target: str, codec: str, now: datetime,
            days: int = COMPRESS_AFTER_DAYS) -> DataFrame:
    """Write the days older than `days` from source to target with a codec; one task row tells the sizes.

    The source is read by partition, so newer days are never opened. Rows are ordered by robot and time
    inside a file, which columnar codecs profit from.
    """
    before = f"{now - timedelta(days=days):%Y-%m-%d}"
    old = spark.read.parquet(source).filter(F.col("dt").cast("string") < before)
    order = [c for c in ("robot_id", "event_time") if c in old.columns]
    (gathered(old, "dt").sortWithinPartitions("dt", *order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", CODECS[codec.upper()])
     .partitionBy("dt").parquet(target))
    original, files = _size(spark, source, before)
    compressed, _ = _size(spark, target, before)
    return spark.createDataFrame(
        [(f"{codec}-{before}", "COMPLETED", files, files, original, compressed, codec.upper())], COMPRESSION_TASK)


def _as_text(schema: T.StructType) -> T.StructType:
    """Partition columns as text: an hour `01` read as a number would be written back as `1`."""
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("dt", "hr") else f for f in schema.fields])


def rewrite_in_place(spark: SparkSession, path: str, codec: str, now: datetime, days: int = COMPRESS_AFTER_DAYS) -> DataFrame:
    """Give the days older than `days` of a table partitioned by `dt` (and `hr`) another codec, where they lie.

    One job writes the old days beside the table. Then each day is swapped by renames: the old folder is set aside,
    the new one takes its place, the old one is removed. A day that got or lost files since the job began keeps its
    old folder and is left to the next run, so late rows are never lost. A run that broke off is undone or completed
    by `recover_recoded`, which the next run calls first. The task row counts the files and bytes of the days that
    this run saw (total) and swapped (all other figures); its status is PARTIAL if a day was left.
    """
    recover_recoded(spark, path)
    before = f"{now - timedelta(days=days):%Y-%m-%d}"
    old_days = [n for n in folder_names(spark, path) if n.startswith("dt=") and n.removeprefix("dt=") < before]
    sizes = {n: folder_size(spark, f"{path}/{n}") for n in old_days}
    swapped = []
    if old_days:
        schema = _as_text(spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in old_days]).schema)
        old = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{n}" for n in old_days])
        parts = [c for c in ("dt", "hr") if c in old.columns]
        order = [c for c in ("robot_id", "event_time") if c in old.columns]
        (gathered(old, *parts).sortWithinPartitions(*parts, *order).write.mode("overwrite")
         .option("partitionOverwriteMode", "static").option("compression", CODECS[codec.upper()])
         .partitionBy(*parts).parquet(f"{path}/{RECODED}"))
        make_folder(spark, f"{path}/{REPLACED}")
        swapped = [n for n in old_days if _swap(spark, path, n, sizes[n])]
        remove_path(spark, f"{path}/{RECODED}")
        remove_path(spark, f"{path}/{REPLACED}")
    compressed = sum(folder_size(spark, f"{path}/{n}")[0] for n in swapped)
    return spark.createDataFrame([(
        f"{codec}-{before}", "COMPLETED" if len(swapped) == len(old_days) else "PARTIAL", sum(s[1] for s in sizes.values()),
        sum(sizes[n][1] for n in swapped), sum(sizes[n][0] for n in swapped), compressed, codec.upper())], COMPRESSION_TASK)


def _swap(spark: SparkSession, path: str, day: str, size: tuple[int, int]) -> bool:
    """Put the rewritten day in place if the old one is what the job read. A day without rows has no rewritten folder."""
    live, new, old = f"{path}/{day}", f"{path}/{RECODED}/{day}", f"{path}/{REPLACED}/{day}"
    if not path_exists(spark, new) or folder_size(spark, live) != size:
        return False
    move_path(spark, live, old)
    if folder_size(spark, old) != size or path_exists(spark, live):  # rows came in between
        move_into(spark, old, live)
        return False
    move_path(spark, new, live)
    remove_path(spark, old)
    return True


def recover_recoded(spark: SparkSession, path: str) -> None:
    """After a broken-off rewrite: days that were set aside without a successor come back, others are cleared away.

    A rewritten folder that still lies beside the table shows that its day was not swapped.
    """
    aside = f"{path}/{REPLACED}"
    for day in folder_names(spark, aside) if path_exists(spark, aside) else []:
        if path_exists(spark, f"{path}/{day}") and not path_exists(spark, f"{path}/{RECODED}/{day}"):
            remove_path(spark, f"{aside}/{day}")
        else:
            move_into(spark, f"{aside}/{day}", f"{path}/{day}")
    for name in (aside, f"{path}/{RECODED}"):
        if path_exists(spark, name):
            remove_path(spark, name)


def decompress(spark: SparkSession, source: str, target: str, now: datetime, days: int = COMPRESS_AFTER_DAYS) -> DataFrame:
    """The same rewrite without compression."""
    return rewrite(spark, source, target, "NONE", now, days)


def task_ratio(tasks: DataFrame) -> DataFrame:
    """Saved percent and megabytes per task."""
    saved = F.col("original_size") - F.col("compressed_size")
    return tasks.withColumns({
        "ratio": F.when(F.col("original_size") > 0, saved / F.col("original_size") * 100).otherwise(0.0),
        "saved_mb": saved / 1024 / 1024})
