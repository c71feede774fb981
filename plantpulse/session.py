"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.functions import broadcast


def build_session(app: str = "plantpulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Adaptive execution does the work that would otherwise need hints: it picks
    broadcast joins by measured size, splits skewed join partitions and merges
    small shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="plantpulse-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def pin(df):
    """Reliable checkpoint: cuts lineage and fixes the partition layout, survives executor loss."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table on whatever file system it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path, from the file system's listing: no data file is opened."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def move_path(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def move_into(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to a place that may exist already: what the target lacks is moved, folders on both sides are
    merged. File names are unique, so a broken-off move is completed by the next one."""
    if not path_exists(spark, target):
        return move_path(spark, source, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for found in path(source).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path(source)):
        name = found.getPath().getName()
        if found.isDirectory():
            move_into(spark, f"{source}/{name}", f"{target}/{name}")
        elif not path_exists(spark, f"{target}/{name}"):
            move_path(spark, f"{source}/{name}", f"{target}/{name}")
    remove_path(spark, source)


def folder_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and files below a folder, from the file system's own summary."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target)
    return found.getLength(), found.getFileCount()


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def small(df, rows: int = 20_000):
    """Broadcast hint for a table that turns out to have at most `rows` rows; larger ones are left to
    the planner. For configuration tables whose size Spark cannot know, such as rules made in Python."""
    return broadcast(df) if df.limit(rows + 1).count() <= rows else df
