"""Incremental backups by the difference of file manifests.

A table is a set of files that are never changed in place. The manifest of a backup lists every file of the table with
its length and time of change; an increment copies the files that the last manifest does not list like that, and notes
those that are gone. Rows that changed are in new files, so they are saved like new rows, and no row of the history is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.session import path_exists

# What tells one state of a file from another.
STATE = ["file", "length", "modified"]


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file (relative to the table), length, modified of all data files, from the listing: contents stay unread."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    root = f"^.*?{_pattern(path)}/*"
    return names.select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.lit(root), F.lit("")).alias("file"),
                        "length", F.col("modificationTime").alias("modified"))


def _pattern(path: str) -> str:
    bare = path.split("://", 1)[-1] if "://" in path else path.removeprefix("file:")
    return "\\Q" + bare.rstrip("/") + "\\E"


def changed_files(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Files that are new or not as they were: file, length, modified."""
    return now if before is None else now.join(before.select(*STATE), STATE, "left_anti")


def save_part(spark: SparkSession, table: str, part: str, earlier: list[str] | None = None) -> DataFrame:
    """Save what changed in a table since the last of the `earlier` parts (none: everything). Returns the new manifest.

    Rows are read from the changed files alone and carry the name of their file, so that a restore picks the newest
    state of each file. Only names of changed files pass the driver, as in any listing.
    """
    before = spark.read.parquet(f"{earlier[-1]}/manifest") if earlier else None
    now = file_manifest(spark, table)
    now.write.mode("overwrite").parquet(f"{part}/manifest")
    now = spark.read.parquet(f"{part}/manifest")
    names = [r.file for r in changed_files(now, before).select("file").collect()]  # file names, not rows
    if names:
        rows = spark.read.option("mergeSchema", True).option("basePath", table).parquet(*[f"{table}/{n}" for n in names])
        held = F.col("_metadata.file_path")
        named = rows.withColumn("saved_file", F.regexp_replace(F.url_decode(F.replace(held, F.lit("+"), F.lit("%2B"))),
                                                               F.lit(f"^.*?{_pattern(table)}/*"), F.lit("")))
        named.write.mode("overwrite").parquet(f"{part}/rows")
    return now


def restored_rows(spark: SparkSession, parts: list[str]) -> DataFrame:
    """The table as the last part saw it: of every file it lists, the rows of the newest part that holds the file in that state."""
    last = spark.read.parquet(f"{parts[-1]}/manifest").select("file")
    out, taken = None, None
    for part in reversed(parts):
        if not path_exists(spark, f"{part}/rows"):
            continue
        rows = spark.read.parquet(f"{part}/rows")
        own = rows.select("saved_file").distinct()
        wanted = last.join(own, last["file"] == own["saved_file"]).select("file")
        wanted = wanted if taken is None else wanted.join(taken, "file", "left_anti")
        kept = rows.join(wanted, rows["saved_file"] == wanted["file"], "left_semi").drop("saved_file")
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
        files = own.select(F.col("saved_file").alias("file"))
        taken = files if taken is None else taken.unionByName(files)
    if out is None:
        raise FileNotFoundError(f"no saved rows in {parts}")
    return out
