"""Increments by file manifests: changed and removed rows, parts without changes."""

import pytest
from pyspark.sql import functions as F

from plantpulse.lifecycle import increments


def rows(df):
    return sorted(map(tuple, df.select("id", "value", "dt").collect()))


def table(spark, path, n, value="old"):
    spark.range(n).select("id", F.lit(value).alias("value"), (F.col("id") % 3).cast("int").alias("dt")).write.partitionBy("dt").mode(
        "overwrite").option("partitionOverwriteMode", "static").parquet(path)


def test_changed_and_removed_files_are_restored(spark, folder):
    path, parts = f"{folder}/table", [f"{folder}/p{i}" for i in range(3)]
    table(spark, path, 30)
    increments.save_part(spark, path, parts[0])
    changed = spark.read.parquet(path).filter("dt = 1").withColumn("value", F.lit("new")).collect()
    spark.createDataFrame([(r.id, r.value) for r in changed], "id bigint, value string").write.mode("overwrite").parquet(f"{path}/dt=1")
    increments.save_part(spark, path, parts[1], parts[:1])
    saved = spark.read.parquet(f"{parts[1]}/rows")
    assert {r.dt for r in saved.select("dt").distinct().collect()} == {1}
    assert rows(increments.restored_rows(spark, parts[:2])) == rows(spark.read.parquet(path))
    assert rows(increments.restored_rows(spark, parts[:1])) == [(i, "old", i % 3) for i in range(30)]
    increments.save_part(spark, path, parts[2], parts[:2])
    assert rows(increments.restored_rows(spark, parts)) == rows(spark.read.parquet(path))


def test_nothing_saved(spark, folder):
    with pytest.raises(Exception):
        increments.restored_rows(spark, [f"{folder}/none"])
