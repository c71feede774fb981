"""Readings straight after ingest, rewrites in place, partition drops in blocks."""

from __future__ import annotations

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plantpulse.lifecycle import compression, retention
from plantpulse.plans import router
from plantpulse.session import move_path, path_exists
from plantpulse.sinks import tables
from plantpulse.sources import star
from plantpulse.streaming import compact, ingest

NOW = datetime(2024, 1, 31)


def rows_of(df, *columns):
    return sorted(df.select("data_id", *columns).collect())


@pytest.fixture
def ingested(spark, sf, folder):
    from __spark_entry__ import _message_stream

    ingest.start_ingest(_message_stream(spark, sf), folder, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return folder


def test_live_readings_before_between_and_after(spark, ingested):
    want = rows_of(ingest.ingested(spark, ingested))
    assert len(want) > 0 and rows_of(compact.live_readings(spark, ingested)) == want
    before = compact.live_readings(spark, ingested)
    assert compact.compact(spark, ingested, linger=True) == 1
    assert path_exists(spark, f"{ingested}/rows/batch_id=0/outcome=accepted")
    assert rows_of(before) == want  # a reader that began before the run still finds its files
    after = compact.live_readings(spark, ingested)
    assert rows_of(after) == want
    assert compact.compact(spark, ingested, linger=True) == 0
    assert not path_exists(spark, f"{ingested}/rows/batch_id=0/outcome=accepted")
    assert rows_of(after) == want


def test_unfinished_compaction_is_not_read(spark, ingested):
    want = rows_of(compact.live_readings(spark, ingested))
    compact.compact(spark, ingested, linger=True)
    os.remove(f"{ingested}/facts/upto=0/_SUCCESS")
    assert rows_of(compact.live_readings(spark, ingested)) == want


def test_live_tables_prune_days(spark, sf, ingested):
    compact.compact(spark, ingested)
    live = compact.live_tables(spark, ingested, star.dim_robot(spark, sf))
    out = router.route_query(live, "2024-01-15 00:00:00", "2024-01-15 10:00:00", metrics=["temperature"])
    assert "dt" in out._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert out.count() > 0


def test_nothing_ingested(spark, folder):
    assert compact.live_readings(spark, folder + "/none").count() == 0


@pytest.mark.parametrize("hours", [False, True])
def test_rewrite_in_place(spark, sf, folder, hours):
    r = star.readings(spark, sf)
    if hours:
        tables.with_partitions(r).write.partitionBy("dt", "hr").parquet(folder + "/t")
    else:
        tables.append_readings(r, folder + "/t")
    names = sorted(d for d, _, files in os.walk(folder + "/t") if any(f.endswith(".parquet") for f in files))
    want = rows_of(spark.read.parquet(folder + "/t"), "robot_id", "event_time")
    task = compression.rewrite_in_place(spark, folder + "/t", "GZIP", NOW, days=16).first()
    assert rows_of(spark.read.parquet(folder + "/t"), "robot_id", "event_time") == want
    assert names == sorted(d for d, _, files in os.walk(folder + "/t") if any(f.endswith(".parquet") for f in files))
    for day in glob.glob(folder + "/t/dt=*"):
        files = glob.glob(day + "/**/*.parquet", recursive=True)
        assert all((".gz." in f) == (os.path.basename(day) < "dt=2024-01-15") for f in files)
    assert task.status == "COMPLETED" and task.original_size > 0 and task.compressed_files == task.total_files > 0
    again = compression.rewrite_in_place(spark, folder + "/t", "GZIP", datetime(2023, 1, 1)).first()
    assert (again.total_files, again.original_size, again.compressed_size) == (0, 0, 0)


def test_rewrite_leaves_days_that_changed(spark, sf, folder, monkeypatch):
    path = folder + "/t"
    r = star.readings(spark, sf)
    tables.append_readings(r, path)
    late = r.filter(F.to_date("event_time") == F.lit("2024-01-03").cast("date"))
    before = compression.make_folder

    def arrive(spark, name):
        tables.append_readings(late, path)
        before(spark, name)

    monkeypatch.setattr(compression, "make_folder", arrive)
    task = compression.rewrite_in_place(spark, path, "GZIP", NOW, days=16).first()
    assert task.status == "PARTIAL" and task.compressed_files < task.total_files
    assert rows_of(spark.read.parquet(path)) == rows_of(r.unionByName(late))


@pytest.mark.parametrize("step", ["written", "aside", "swapped"])
def test_broken_rewrite_is_recovered(spark, sf, folder, step, monkeypatch):
    path, day = folder + "/t", "dt=2024-01-05"
    tables.append_readings(star.readings(spark, sf), path)
    want = rows_of(spark.read.parquet(path))

    def broken(spark, path, name, size):
        if step != "written":
            move_path(spark, f"{path}/{day}", f"{path}/_replaced/{day}")
        if step == "swapped":
            move_path(spark, f"{path}/_recoded/{day}", f"{path}/{day}")
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(compression, "_swap", broken)
        with pytest.raises(RuntimeError):
            compression.rewrite_in_place(spark, path, "GZIP", NOW, days=16)
    compression.recover_recoded(spark, path)
    assert rows_of(spark.read.parquet(path)) == want
    assert not path_exists(spark, f"{path}/_recoded") and not path_exists(spark, f"{path}/_replaced")
    assert compression.rewrite_in_place(spark, path, "GZIP", NOW, days=16).first().status == "COMPLETED"
    assert rows_of(spark.read.parquet(path)) == want


def test_partitions_are_dropped_in_blocks(spark, readings, folder, monkeypatch):
    name = "blocks_" + folder[-8:]
    r = readings(*[{"event_time": datetime(2024, 1, d, h), "robot_id": f"R{d}"} for d in (1, 2, 3) for h in (1, 2)])
    tables.save_fact_table(r, name, buckets=2, path=folder)
    monkeypatch.setattr(retention, "DROPPED_AT_ONCE", 3)
    try:
        assert len(retention.drop_expired_partitions(spark, name, datetime(2024, 1, 3))) == 4
        assert spark.table(name).count() == 2
        assert retention.drop_expired_partitions(spark, name, datetime(2024, 1, 3)) == []
    finally:
        spark.sql(f"DROP TABLE {name}")
