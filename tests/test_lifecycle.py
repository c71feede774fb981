import glob
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.lifecycle import backup, catalog, compression, retention
from plantpulse.operators.monitoring import compression_statistics
from plantpulse.sinks import export, tables
from plantpulse.sources import star

NOW = datetime(2024, 1, 31)


def all_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_delete_is_strict_and_keeps_later_days(spark, readings, folder):
    cut = datetime(2024, 1, 10, 12)
    moments = [cut - timedelta(days=3), cut - timedelta(seconds=1), cut, cut + timedelta(days=2)]
    tables.append_readings(readings(*[{"event_time": t} for t in moments]), folder)
    preview = retention.cleanup_preview(spark.read.parquet(folder), cut).first()
    assert (preview.rows_to_delete, preview.affected_partitions, preview.oldest) == (2, 2, moments[0])
    later = glob.glob(folder + "/dt=2024-01-12/*.parquet")
    retention.delete_older(spark, folder, cut)
    assert [r.event_time for r in spark.read.parquet(folder).orderBy("event_time").collect()] == moments[2:]
    assert glob.glob(folder + "/dt=2024-01-12/*.parquet") == later
    retention.delete_older(spark, folder, cut)
    assert spark.read.parquet(folder).count() == 2
    assert retention.cutoff(NOW) == NOW - timedelta(days=90)


def test_bytes_by_partition(spark, readings, folder):
    tables.append_readings(readings(*[{"event_time": datetime(2024, 1, d)} for d in (1, 2, 3)]), folder)
    assert retention.cleanup_bytes(spark, folder, datetime(2024, 1, 3)).first().files == 2
    assert retention.storage_bytes(spark, folder).filter("dt != ''").count() == 3
    stats = retention.storage_stats(spark.read.parquet(folder)).first()
    assert (stats.total_rows, stats.partition_count, stats.rows_per_day) == (3, 3, 1.0)


def test_catalog_and_partition_drop(spark, readings, folder):
    name = "history_" + folder[-8:]
    r = readings(*[{"event_time": datetime(2024, 1, d, h), "robot_id": f"R{d}"} for d in (1, 2, 3) for h in (1, 2)])
    tables.save_fact_table(r, name, buckets=2, path=folder)
    try:
        assert catalog.partitions(spark, name).count() == 6
        assert name in {x.tableName for x in catalog.tables(spark).collect()}
        described = {x.col_name for x in catalog.describe(spark, name).collect()}
        assert {"event_time", "dt", "hr"} <= described
        gone = retention.drop_expired_partitions(spark, name, datetime(2024, 1, 2, 12))
        assert gone == ["dt=2024-01-01/hr=01", "dt=2024-01-01/hr=02"]
        assert spark.table(name).count() == 4
        plan = spark.table(name).groupBy("robot_id").count()._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan
    finally:
        spark.sql(f"DROP TABLE {name}")
    for bad in ("a;b", "1a", "x y"):
        with pytest.raises(ValueError):
            catalog.partitions(spark, bad)
        with pytest.raises(ValueError):
            catalog.describe(spark, bad)


@pytest.mark.parametrize("strategy,columns", [("DAILY", 1), ("ROBOT", 1), ("COMBINED", 2)])
def test_strategies(spark, readings, folder, strategy, columns):
    name = "strategy_" + folder[-8:]
    tables.save_fact_table(readings({"temperature": 1.0}), name, strategy, buckets=2, path=folder)
    try:
        assert catalog.partitions(spark, name).first().partition.count("=") == columns
        assert spark.table(name).first().temperature == 1.0
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_external_table(spark, readings, folder):
    name = "external_" + folder[-8:]
    tables.append_readings(readings({}, {"event_time": datetime(2024, 1, 2)}), folder)
    schema = spark.read.parquet(folder).schema
    catalog.create_external(spark, name, schema, folder, ["dt"])
    try:
        catalog.repair(spark, name)
        assert catalog.partitions(spark, name).count() == 2
        catalog.drop_partition(spark, name, {"dt": "2024-01-01"})
        assert spark.table(name).count() == 1
        catalog.add_partition(spark, name, {"dt": "2024-01-01"}, folder + "/dt=2024-01-01")
        assert spark.table(name).count() == 2
        with pytest.raises(ValueError):
            catalog.drop_partition(spark, name, {"dt": "x') --"})
    finally:
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("codec", ["GZIP", "SNAPPY", "LZ4", "ZSTD"])
def test_rewrite_old_days_only(spark, sf, folder, codec):
    r = star.readings(spark, sf)
    tables.append_readings(r, folder + "/a")
    task = compression.rewrite(spark, folder + "/a", folder + "/b", codec, NOW, days=16)
    old = r.filter(F.col("event_time") < F.lit(datetime(2024, 1, 15)))
    assert all_rows(spark.read.parquet(folder + "/b"), "data_id") == all_rows(old, "data_id")
    row = compression.task_ratio(task).first()
    assert row.original_size > 0 and row.ratio == pytest.approx((1 - row.compressed_size / row.original_size) * 100)
    assert compression_statistics(task).first().total_original_size == row.original_size
    names = " ".join(glob.glob(folder + "/b/dt=*/*.parquet"))
    assert {"GZIP": ".gz.", "SNAPPY": ".snappy.", "LZ4": ".lz4", "ZSTD": ".zstd."}[codec] in names


def test_decompress(spark, sf, folder):
    tables.append_readings(star.readings(spark, sf), folder + "/a")
    compression.decompress(spark, folder + "/a", folder + "/b", NOW, days=0)
    assert spark.read.parquet(folder + "/b").count() == spark.read.parquet(folder + "/a").count()


def test_backup_round_trip(spark, sf, folder):
    r, dims = star.readings(spark, sf), star.dim_robot(spark, sf)
    split = datetime(2024, 1, 15)
    old = r.filter(F.col("event_time") <= F.lit(split))
    backup.full_backup(spark, {"readings": old, "robots": dims}, folder + "/full", split)
    backup.incremental_backup(spark, {"readings": r}, folder + "/inc", split, NOW, [folder + "/full"])
    assert all(x.intact for x in backup.verify(spark, folder + "/full").collect())
    check = backup.restore(spark, "readings", folder + "/dry", folder + "/full", [folder + "/inc"], dry_run=True)
    assert check.count() == 2 and not glob.glob(folder + "/dry")
    backup.restore(spark, "readings", folder + "/back", folder + "/full", [folder + "/inc"])
    assert backup.same_content(spark.read.parquet(folder + "/back"), r)
    with pytest.raises(Exception):
        backup.restore(spark, "readings", folder + "/back", folder + "/full", [folder + "/inc"])
    backup.restore(spark, "readings", folder + "/back", folder + "/full", overwrite=True)
    assert backup.same_content(spark.read.parquet(folder + "/back"), old)


def test_late_rows_and_rows_without_time_are_saved(spark, readings, folder):
    t = datetime(2024, 1, 5)
    rows = readings({"event_time": t}, {"event_time": t + timedelta(1)}, {"event_time": None}, {"event_time": t - timedelta(9)},
                    {"event_time": t + timedelta(9)}, {"data_id": None, "event_time": None})
    backup.full_backup(spark, {"readings": rows.filter("data_id in ('d000', 'd001')")}, folder + "/full", t)
    backup.incremental_backup(spark, {"readings": rows.filter("data_id <> 'd004'")}, folder + "/a", t, NOW, [folder + "/full"])
    backup.incremental_backup(spark, {"readings": rows}, folder + "/b", t, NOW, [folder + "/full", folder + "/a"])
    assert spark.read.parquet(folder + "/a/readings").count() == 2 and spark.read.parquet(folder + "/b/readings").count() == 2
    assert backup.same_content(backup.restored(spark, "readings", folder + "/full", [folder + "/a", folder + "/b"]), rows)


def test_digest_sees_every_change(readings):
    one = readings(*[{"temperature": float(i), "data_id": f"x{i}"} for i in range(40)])
    base = sorted(map(tuple, backup.digest_counts(one).collect()))
    changed = one.withColumn("temperature", F.when(F.col("data_id") == "x7", 7.5).otherwise(F.col("temperature")))
    moved = one.withColumns({"sensor_id": F.lit(None).cast("string"), "sensor_type": F.col("sensor_id")})
    assert base != sorted(map(tuple, backup.digest_counts(changed).collect()))
    a = one.withColumns({"sensor_id": F.lit("v"), "sensor_type": F.lit(None).cast("string")})
    b = one.withColumns({"sensor_id": F.lit(None).cast("string"), "sensor_type": F.lit("v")})
    assert sorted(map(tuple, backup.digest_counts(a).collect())) != sorted(map(tuple, backup.digest_counts(b).collect()))
    assert moved.count() == 40


def test_broken_off_retention_is_completed(spark, readings, folder):
    rows = readings(*[{"event_time": datetime(2024, 1, d, h)} for d in (1, 2, 3) for h in (3, 15)])
    tables.append_readings(rows, folder)
    before = datetime(2024, 1, 2, 12)
    edge = spark.read.parquet(folder + "/dt=2024-01-02")
    retention.kept(edge, before).write.parquet(folder + "/_staged_dt=2024-01-02")
    retention.remove_path(spark, folder + "/dt=2024-01-02")  # broke off before the rename
    retention.delete_older(spark, folder, before)
    assert sorted(r.event_time for r in spark.read.parquet(folder).collect()) == [
        datetime(2024, 1, 2, 15), datetime(2024, 1, 3, 3), datetime(2024, 1, 3, 15)]
    assert not glob.glob(folder + "/_staged*")


def test_time_bounds_prune_days(spark, readings, folder):
    from plantpulse.operators import monitoring
    from plantpulse.plans import jobs, rollup
    rows = readings(*[{"event_time": datetime(2024, 1, d, 3)} for d in (1, 2, 3)])
    tables.append_readings(rows, folder + "/facts")
    jobs.store_hourly_rollup(rows, folder + "/rollup")
    facts, hourly = spark.read.parquet(folder + "/facts"), spark.read.parquet(folder + "/rollup")
    for df in (monitoring.system_performance(facts, datetime(2024, 1, 4)), retention.kept(facts, datetime(2024, 1, 2)),
               retention.cleanup_preview(facts, datetime(2024, 1, 2)), backup.incremental_delta(facts, datetime(2024, 1, 2)),
               jobs.daily_summary(facts, datetime(2024, 1, 2).date()),
               rollup.from_hourly(hourly, datetime(2024, 1, 2), datetime(2024, 1, 3), ["temperature"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan and "PartitionFilters: [" in plan


def test_damaged_backup_is_refused(spark, sf, folder):
    backup.full_backup(spark, {"readings": star.readings(spark, sf)}, folder, NOW)
    star.readings(spark, sf).withColumn("pressure", F.lit(1.0)).write.mode("overwrite").parquet(folder + "/readings")
    assert not backup.verify(spark, folder).first().intact
    with pytest.raises(ValueError):
        backup.restore(spark, "readings", folder + "/x", folder)


def test_checksum_notices_duplicates(spark):
    one = spark.range(5)
    assert not backup.same_content(one, one.unionByName(one))
    assert not backup.same_content(spark.range(0), one)
    assert backup.same_content(one.orderBy(F.desc("id")), one)


def test_files(spark, readings, folder):
    for part in ("a", "b"):
        readings({}).coalesce(1).write.csv(f"{folder}/{part}")
    assert backup.file_digests(spark, folder).select("md5").distinct().count() >= 1
    assert backup.same_files(spark, folder + "/a", folder + "/a").filter("not same").count() == 0
    assert backup.expired_summary(spark, folder, datetime(2000, 1, 1)).first()[:] == (0, 0)
    assert backup.expired_summary(spark, folder, datetime(2100, 1, 1)).first().files >= 2


def test_export(spark, folder):
    routed = spark.createDataFrame([("R1", 1.5, None, 3)], "robot_id string, avg_temperature double, avg_humidity double, data_count long").coalesce(1)
    export.export(routed, folder + "/csv", "csv", NOW)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(folder + "/csv/*.csv"))
    assert text.splitlines() == [",".join(export.HEADINGS), "R1,,,1.5,,,,,,,3"]
    export.export(routed, folder + "/excel", "EXCEL", NOW)
    export.export(routed, folder + "/json", "json", NOW)
    header = json.loads("".join(open(f).read() for f in glob.glob(folder + "/json/header/*.json")))
    assert header == {"export_time": "2024-01-31 00:00:00", "total_records": 1}
    assert spark.read.json(folder + "/json/rows").first().robot_id == "R1"
    with pytest.raises(ValueError):
        export.export(routed, folder, "xml", NOW)
    assert export.content_type("xlsx").endswith("sheet") and export.content_type("?") == "application/octet-stream"
    assert export.file_name(NOW, NOW, "csv") == "sensor_data_20240131000000_20240131000000.csv"


def test_summary_tables_replace_partitions(spark, folder):
    a = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "dt string, n int")
    tables.write_summary(a, folder, ["dt"])
    tables.write_summary(a.filter("n = 2").withColumn("n", F.lit(5)), folder, ["dt"])
    assert sorted(r.n for r in spark.read.parquet(folder).collect()) == [1, 5]
    tables.write_summary(a.limit(1), folder + "/plain")
    assert spark.read.parquet(folder + "/plain").count() == 1
