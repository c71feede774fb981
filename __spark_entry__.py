"""Registered queries over the test tables, and the same questions in DuckDB SQL."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plantpulse.functions import mask, metrics as metric_fn, text, timefn, validate  # noqa: E402
from plantpulse.lifecycle import backup, compression, digests, increments, retention  # noqa: E402
from plantpulse.operators import alerts, analytics, anomaly, buckets, monitoring, raw, robots, rule_index  # noqa: E402
from plantpulse.plans import jobs, rollup, router  # noqa: E402
from plantpulse.session import work_path  # noqa: E402
from plantpulse.sinks import export, tables as sink_tables  # noqa: E402
from plantpulse.sources import messages, star, streams  # noqa: E402
from plantpulse.streaming import alerts as stream_alerts, compact, ingest, silence, status as stream_status  # noqa: E402
from oracle_queries import ORACLE  # noqa: E402

# The training-data operators may be absent as a whole; any other import error is a fault.
try:
    from plantpulse.llm.entry import ORACLES as LLM_ORACLES, QUERIES as LLM_QUERIES  # noqa: E402
    from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL, run as run_pipeline  # noqa: E402
except ModuleNotFoundError as error:
    if error.name not in ("plantpulse.llm", "plantpulse.llm.entry", "corpus_pipeline"):
        raise
    LLM_ORACLES, LLM_QUERIES, PIPELINE_SQL, run_pipeline = {}, {}, None, None

# The whole test month; the readings run from 2024-01-01 to 2024-01-30.
LOW, HIGH = datetime(2024, 1, 1), datetime(2024, 1, 31)
NOW = HIGH
RULES = [
    ("RULE003", "dry air", "HUMIDITY", "", '{"metric": "humidity", "operator": "<", "threshold": 20, "duration": 600}', "{}", "LOW", 1),
    ("RULE004", "pressure", "PRESSURE", "", '{"metric": "pressure", "operator": ">=", "threshold": 1000, "duration": 3600}', "{}", "MEDIUM", 1),
    ("RULE005", "switched off", "PRESSURE", "", '{"metric": "pressure", "operator": ">", "threshold": 0, "duration": 0}', "{}", "LOW", 0),
]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits. The tiny shift makes exact halves round the same way on both engines."""
    return df.select(*[
        F.round(F.col(n) + F.lit(1e-9), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _tables(spark, d) -> router.Tables:
    r = star.readings(spark, d)
    return router.Tables(recent=r, facts=r, robots=star.dim_robot(spark, d), hourly=rollup.build_hourly(r))


def q_route_stored_rollup(spark, d):
    """The rollup as the daily job stores it, then a long range answered from the stored table."""
    path, r = work_path(spark, "rollup"), star.readings(spark, d)
    jobs.store_hourly_rollup(r, path)
    stored = router.Tables(recent=r, facts=r, robots=star.dim_robot(spark, d), hourly=spark.read.parquet(path))
    return rounded(router.route_query(stored, LOW, HIGH, metrics=["temperature", "humidity"]))


def _routed(spark, d) -> DataFrame:
    return router.incremental(star.readings(spark, d), LOW, HIGH)


def _bucket(kind):
    return lambda s, d: rounded(buckets.bucket_aggregate(star.readings(s, d), LOW, HIGH, kind, ordered=False))


def _trend(interval):
    return lambda s, d: rounded(buckets.trend(star.readings(s, d), LOW, HIGH, interval))


def _event_stream(spark, d) -> DataFrame:
    schema = star.table(spark, d, "events").schema
    return star.events_as_readings(streams.parquet_stream(spark, f"{d}/events.parquet*", schema))


def _message_stream(spark, d) -> DataFrame:
    """Readings as JSON messages; those with an abnormal status arrive cut off."""
    rows = messages.topic_rows(messages.to_events(_event_stream(spark, d)))
    broken = F.get_json_object("value", "$.status") == "ABNORMAL"
    return rows.withColumn("value", F.when(broken, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))


def _ingested(spark, d) -> str:
    path = work_path(spark, "ingest")
    query = ingest.start_ingest(_message_stream(spark, d), path, f"{path}/checkpoint", available_now=True)
    query.awaitTermination()
    return path


def q_stream_sustained(spark, d):
    path = work_path(spark, "sustained")
    query = stream_alerts.start_sustained(
        _event_stream(spark, d), star.alert_rules(spark, RULES), path, f"{path}/checkpoint",
        keys=("robot_id",), available_now=True)
    query.awaitTermination()
    return stream_alerts.raised(spark, path)


def q_stream_sustained_late(spark, d):
    """Readings that come up to 23 hours late, in four sittings of the stream; the rest is judged at the end."""
    path, rules, keys = work_path(spark, "late"), star.alert_rules(spark, RULES), ("robot_id",)
    rows = star.readings(spark, d)
    came = timefn.epoch_seconds("event_time") + F.crc32("data_id") % (23 * 3600)
    low, high = rows.agg(F.min(came), F.max(came)).first()
    sitting = F.floor((came - F.lit(low)) * 4 / F.lit((high or 0) - (low or 0) + 1))
    for number in range(4):
        rows.filter(sitting == number).write.mode("append").parquet(f"{path}/in")
        query = stream_alerts.start_sustained(
            streams.parquet_stream(spark, f"{path}/in", rows.schema), rules, f"{path}/out", f"{path}/checkpoint", keys,
            available_now=True, delay_seconds=86400)
        query.awaitTermination()
    stream_alerts.finish_sustained(spark, rules, f"{path}/out", keys)
    return stream_alerts.raised(spark, f"{path}/out")


def q_checksum_differences(spark, d):
    """Orders and a later copy of them: some lost, some changed, some new. Both are stored with their digest trees."""
    path, orders = work_path(spark, "digests"), star.table(spark, d, "orders")
    kept = orders.filter("o_custkey % 500 <> 7 OR o_orderkey % 2 = 0").withColumn(
        "o_totalprice", F.expr("CASE WHEN o_custkey % 700 = 11 THEN o_totalprice + 1D ELSE o_totalprice END"))
    new = orders.filter("o_custkey % 900 = 13").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    for name, rows in (("before", orders), ("after", kept.unionByName(new))):
        digests.save_copy(rows, ["o_orderkey"], f"{path}/{name}")
    tables = [digests.read_copy(spark, f"{path}/{n}") for n in ("before", "after")]
    trees = [digests.read_tree(spark, f"{path}/{n}") for n in ("before", "after")]
    return digests.differences(*tables, ["o_orderkey"], *trees)


def q_stream_status(spark, d):
    path = work_path(spark, "status")
    query = stream_status.start_status(_event_stream(spark, d), f"{path}/out", f"{path}/checkpoint", available_now=True)
    query.awaitTermination()
    return stream_status.current_status(spark, f"{path}/out", NOW, 6 * 3600)


def q_stream_status_events(spark, d):
    """When robots come and when they fall silent for six hours."""
    return ingest.collect_stream(silence.status_events(_event_stream(spark, d), 6 * 3600), work_path(spark, "events"))


def q_stream_dedup(spark, d):
    once = _event_stream(spark, d)
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    rows = ingest.deduplicated(twice)
    return ingest.collect_stream(rows.select("data_id", "event_time", "robot_id"), work_path(spark, "dedup"))


def q_stream_windows(spark, d):
    rows = ingest.windowed_metrics(_event_stream(spark, d))
    return rounded(ingest.collect_stream(rows, work_path(spark, "windows"), "complete"))


def q_partitioned_write(spark, d):
    """Write the bucketed history table, read it back and aggregate it."""
    path = work_path(spark, "fact")
    name = "fact_" + path.rsplit("-", 1)[1]
    sink_tables.save_fact_table(star.readings(spark, d), name, strategy="DAILY", buckets=4, path=path)
    table = spark.read.orc(path)
    spark.sql(f"DROP TABLE {name}")
    return rounded(table.groupBy(F.col("dt").cast("string").alias("dt"), "robot_id").agg(
        F.count("*").alias("n"), F.max("pressure").alias("max_pressure")))


def q_stream_compacted(spark, d):
    """Ingest to the end, compact the batches into hourly facts, read those."""
    path = _ingested(spark, d)
    compact.compact(spark, path)
    return rounded(compact.facts(spark, path).select("data_id", "event_time", "robot_id", "dt", "hr", "pressure"))


def q_route_ingested(spark, d):
    """Ingest file by file, compact what is there, ingest again, route over facts and batches that wait."""
    path, source = work_path(spark, "live"), work_path(spark, "live-in")
    rows = messages.topic_rows(messages.to_events(star.readings(spark, d)))
    late = F.pmod(F.crc32("value"), F.lit(2)) == 1
    for part, compacted in ((~late, True), (late, False)):
        rows.filter(part).write.mode("append").parquet(source)
        live = streams.parquet_stream(spark, source, rows.schema)
        ingest.start_ingest(live, path, f"{path}/checkpoint", available_now=True).awaitTermination()
        if compacted:
            compact.compact(spark, path, linger=True)
    tables = compact.live_tables(spark, path, star.dim_robot(spark, d))
    return rounded(router.route_query(tables, LOW, HIGH, metrics=["temperature", "humidity", "pressure"], ordered=False))


# Lists as a user passes them: one for an IN predicate, one beyond its bound, which becomes a semi join.
SHORT_LIST = [f"R{i:06d}" for i in range(0, 1200, 3)]
LONG_LIST = [f"R{i:06d}" for i in range(0, 6000, 2)]


def _listed(ids):
    return lambda s, d: rounded(router.route_query(
        _tables(s, d), LOW, HIGH, robot_ids=ids, sensor_types=["TEMPERATURE", "HUMIDITY"],
        metrics=["temperature", "humidity", "pressure"], ordered=False))


def q_compress_in_place(spark, d):
    """Write by day, give the older half another codec where it lies, read the whole table."""
    path = work_path(spark, "recode")
    sink_tables.append_readings(star.readings(spark, d), path)
    compression.rewrite_in_place(spark, path, "ZSTD", NOW, days=15)
    return rounded(spark.read.parquet(path).select(
        "data_id", "robot_id", F.col("dt").cast("string").alias("dt"), "pressure"))


def q_bucketed_read(spark, d):
    """The bucketed history table read as a table: grouping by robot needs no shuffle."""
    path = work_path(spark, "bucketed")
    name = "fact_bucketed_read"  # one name, replaced at every call: no table is left behind for each
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sink_tables.save_fact_table(star.readings(spark, d), name, strategy="DAILY", buckets=4, path=path)
    return rounded(spark.table(name).groupBy("robot_id").agg(F.count("*").alias("n"), F.max("pressure").alias("max_pressure")))


def q_compress_rewrite(spark, d):
    """Write by day, rewrite all days with another codec, read the rewritten table."""
    path = work_path(spark, "compress")
    sink_tables.append_readings(star.readings(spark, d), f"{path}/source")
    compression.rewrite(spark, f"{path}/source", f"{path}/target", "ZSTD", NOW, days=0)
    return rounded(spark.read.parquet(f"{path}/target").select(
        "data_id", "robot_id", F.col("dt").cast("string").alias("dt"), "pressure"))


def q_retention_delete(spark, d):
    path = work_path(spark, "retention")
    sink_tables.append_readings(star.readings(spark, d), path)
    retention.delete_older(spark, path, datetime(2024, 1, 16, 12))
    return spark.read.parquet(path).select("data_id", "event_time", "robot_id")


def q_backup_restore(spark, d):
    """Full backup of the older half, increment of what came later, restore both. One row in ten of the older half
    comes late, and some rows have no time."""
    path, split = work_path(spark, "backup"), datetime(2024, 1, 15)
    number = F.col("data_id").cast("bigint")
    r = star.readings(spark, d).withColumn("event_time", F.when(number % 97 != 0, F.col("event_time")))
    old = r.filter((F.col("event_time") <= timefn.at(split)) & (number % 10 != 0))
    backup.full_backup(spark, {"readings": old}, f"{path}/full", split)
    backup.incremental_backup(spark, {"readings": r}, f"{path}/inc", split, NOW, [f"{path}/full"])
    backup.restore(spark, "readings", f"{path}/restored", f"{path}/full", [f"{path}/inc"])
    return rounded(spark.read.parquet(f"{path}/restored").select("data_id", "event_time", "robot_id", "pressure"))


def q_backup_changed(spark, d):
    """A table by day is saved, the readings of one day are corrected in place, the change is saved, both are restored."""
    path = work_path(spark, "changed")
    sink_tables.append_readings(star.readings(spark, d), f"{path}/table")
    increments.save_part(spark, f"{path}/table", f"{path}/full")
    day = spark.read.parquet(f"{path}/table").filter(F.col("dt").cast("string") == "2024-01-10")
    day.withColumn("pressure", F.col("pressure") + 1).write.parquet(f"{path}/corrected")
    (spark.read.parquet(f"{path}/corrected").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dt").parquet(f"{path}/table"))
    increments.save_part(spark, f"{path}/table", f"{path}/increment", [f"{path}/full"])
    restored = increments.restored_rows(spark, [f"{path}/full", f"{path}/increment"])
    return rounded(restored.select("data_id", "robot_id", F.col("dt").cast("string").alias("dt"), "pressure"))


def q_generic_aggregate(spark, d):
    r = star.readings(spark, d)
    parts = [
        buckets.aggregate(r, metric, interval=interval, by=["sensor_type"]).withColumn("interval", F.lit(interval))
        for metric, interval in (("temperature", "hour"), ("humidity", "day"), ("temperature", "week"), ("pressure", "month"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out.withColumn("sum_value", F.round("sum_value", 2)), 5)


def q_dim_time(spark, d):
    out = timefn.time_dimension(star.readings(spark, d))
    return out.withColumn("full_date", F.col("full_date").cast("string"))


def q_partition_values(spark, d):
    t = "event_time"
    return star.readings(spark, d).groupBy(
        timefn.partition_value(t, "daily").alias("daily"), timefn.partition_value(t, "hourly").alias("hourly"),
        timefn.partition_value(t, "monthly").alias("monthly")).agg(F.count("*").alias("n"))


def q_id_format_check(spark, d):
    r = star.readings(spark, d)
    return r.select("data_id", validate.robot_id_ok("robot_id").alias("robot_ok"),
                    validate.robot_id_ok(F.lower("robot_id")).alias("lower_ok"),
                    validate.sensor_type_ok("sensor_type").alias("type_ok"),
                    validate.sensor_type_ok("sensor_id").alias("id_as_type_ok"))


def q_json_validity(spark, d):
    e = star.table(spark, d, "events")
    kind = F.col("event_type")
    e = e.select("event_id", F.when(kind == "error", F.expr("substring(props, 2)"))
                 .when(kind == "signup", F.concat(F.lit("["), F.col("props"), F.lit("]")))
                 .otherwise(F.col("props")).alias("doc"))
    return e.select("event_id", text.json_valid("doc").alias("is_json"), text.json_object("doc").alias("is_object"),
                    text.json_array("doc").alias("is_array"))


def q_collect_counts(spark, d):
    rows = messages.to_events(star.readings(spark, d), "temperature", "humidity", "pressure", keep_nulls=True)
    ok = validate.http_valid()
    return rows.agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("fail_count"))


def q_topic_routing(spark, d):
    rows = messages.topic_rows(messages.to_events(star.readings(spark, d)))
    sent = F.from_json("value", "data_id string, metrics struct<temperature: double>, event_time string")
    return rounded(rows.select("topic", "key", sent.alias("m")).select(
        "topic", "key", "m.data_id", F.col("m.metrics.temperature").alias("temperature"), "m.event_time"))


def q_validate_stream(spark, d):
    rows = messages.to_events(star.readings(spark, d))
    reason = validate.stream_reason()
    return rows.select("data_id", reason.isNull().alias("valid"), reason.alias("reason"))


def q_validate_http(spark, d):
    rows = messages.to_events(star.readings(spark, d), "temperature", "humidity", "pressure", keep_nulls=True)
    rows = rows.withColumn("valid", F.col("status") == "NORMAL")
    return rows.select("data_id", validate.http_valid().alias("http_ok"), validate.entity_valid().alias("entity_ok"))


def q_metric_map(spark, d):
    rows = messages.to_events(star.readings(spark, d))
    changed = rows.withColumn("metrics", metric_fn.with_metric("metrics", "noise", F.lit(1.5)))
    return rounded(changed.select(
        "data_id", metric_fn.metric_value("metrics", "humidity").alias("humidity"),
        metric_fn.metric_value("metrics", "temperature").alias("temperature"),
        metric_fn.metric_value("metrics", "noise").alias("noise"), F.size("metrics").alias("entries")))


def q_desensitize(spark, d):
    r = star.readings(spark, d).select("data_id", "robot_id", "temperature", "pressure", "status")
    return rounded(mask.desensitize(r, {"robot_id": "MASK", "temperature": "ROUND", "status": "OTHER", "data": "MASK"}))


def q_desensitize_noise(spark, d):
    r = star.readings(spark, d).select("data_id", "pressure")
    return rounded(mask.desensitize(r, {"pressure": "NOISE"}, seed=7, key="data_id"))


def q_robot_updates(spark, d):
    out = robots.upsert_robots(star.dim_robot(spark, d), star.robot_updates(spark, d))
    return out.select("robot_id", "robot_name", "status", "location", "update_time")


def q_status_by_ids(spark, d):
    return robots.status_by_ids(star.robot_status(spark, d), ids=star.listed_robots(spark, d)).select("robot_id", "robot_name", "status")


def q_status_topics(spark, d):
    st = star.robot_status(spark, d).select("robot_id", "status", "task_status")
    return robots.status_messages(st)


def q_alert_topics(spark, d):
    found = robots.robot_alerts(star.robot_status(spark, d))
    return robots.alert_messages(found.select("robot_id", "alert_type", "severity"))


def q_command_topics(spark, d):
    return robots.command_messages(star.commands(spark, d).select("command_id", "robot_id", "status"))


def q_command_timers(spark, d):
    log = star.run_log(spark, d)
    return rounded(monitoring.timer(log, "duration_ms", "job_type", "status"), 2)


def q_message_rates(spark, d):
    log = star.table(spark, d, "lineitem").select((F.col("l_returnflag") != "R").alias("acked"))
    return rounded(monitoring.message_rates(log))


def q_report_detailed(spark, d):
    parts = analytics.report(_routed(spark, d), "detailed")
    names = ["avg_temperature", "avg_humidity", "avg_pressure"]
    rows = parts["data"].select("robot_id", *names)
    total = parts["summary"].select(F.lit("ALL").alias("robot_id"), *[
        F.col(f"{n[4:]}_avg").alias(n) for n in names])
    return rounded(rows.unionByName(total))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_telemetry_queries(), **LLM_QUERIES, **({"pipeline": run_pipeline} if run_pipeline else {})}


def _telemetry_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    r, st, cmd = star.readings, star.robot_status, star.commands
    return {
        # routed aggregates
        "route_realtime": lambda s, d: rounded(router.realtime(r(s, d), star.dim_robot(s, d), LOW, HIGH)),
        "route_realtime_window": lambda s, d: rounded(router.route_query(
            _tables(s, d), "2024-01-10 12:00:00", "2024-01-10 12:05:00", metrics=["temperature", "humidity", "pressure"])),
        "route_incremental": lambda s, d: rounded(router.incremental(r(s, d), LOW, HIGH)),
        "route_incremental_day": lambda s, d: rounded(router.route_query(
            _tables(s, d), "2024-01-15 00:00:00", "2024-01-16 00:00:00", metrics=["temperature", "humidity", "pressure"])),
        "route_historical_rollup": lambda s, d: rounded(router.route_query(
            _tables(s, d), LOW, HIGH, metrics=["temperature", "humidity"])),
        "route_historical_fallback": lambda s, d: rounded(router.route_query(
            _tables(s, d), LOW, HIGH, metrics=["temperature", "pressure"])),
        "route_stored_rollup": q_route_stored_rollup,
        "route_listed_short": _listed(SHORT_LIST), "route_listed_long": _listed(LONG_LIST),
        "route_ingested": q_route_ingested,
        "hourly_rollup": lambda s, d: rounded(rollup.build_hourly(r(s, d))),
        # buckets and trends
        "bucket_minute": _bucket("minute"), "bucket_hourly": _bucket("hourly"),
        "bucket_daily": _bucket("daily"), "bucket_weekly": _bucket("weekly"),
        "trend_minute": _trend("minute"), "trend_hour": _trend("hour"), "trend_day": _trend("day"),
        "generic_aggregate": q_generic_aggregate,
        # analytics
        "statistics": lambda s, d: rounded(analytics.statistics(_routed(s, d))),
        "overview": lambda s, d: rounded(analytics.overview(r(s, d), LOW, HIGH)),
        "quality_report": lambda s, d: rounded(analytics.quality(_routed(s, d))),
        "distribution": lambda s, d: rounded(analytics.distribution(_routed(s, d), "temperature", 10)),
        "distribution_with_max": lambda s, d: rounded(analytics.distribution(_routed(s, d), "humidity", 7, include_max=True)),
        "chart_series": lambda s, d: rounded(analytics.chart_series(_routed(s, d))),
        "report_detailed": q_report_detailed,
        "daily_summary": lambda s, d: rounded(jobs.daily_summary(r(s, d)).withColumn("dt", F.col("dt").cast("string"))),
        "weekly_report": lambda s, d: jobs.weekly_reports(r(s, d)),
        "export_csv_rows": lambda s, d: rounded(export.export_rows(
            router.realtime(r(s, d), star.dim_robot(s, d), LOW, HIGH))),
        "export_json_header": lambda s, d: export.export_header(_routed(s, d), NOW),
        "desensitize": q_desensitize, "desensitize_noise": q_desensitize_noise,
        # anomalies and alerts
        "anomaly_statistical": lambda s, d: rounded(anomaly.statistical(_routed(s, d))),
        "anomaly_threshold": lambda s, d: rounded(anomaly.threshold(
            jobs.daily_summary(r(s, d)).select("robot_id", "avg_temperature"))),
        "anomaly_all": lambda s, d: rounded(anomaly.detect(
            jobs.daily_summary(r(s, d)).select("robot_id", "avg_temperature"), ["statistical", "threshold"])),
        "robot_abnormal": lambda s, d: robots.abnormal_robots(st(s, d)).select(
            "robot_id", "abnormal", "severity", "description"),
        "robot_alerts": lambda s, d: robots.robot_alerts(st(s, d)),
        "alert_rules_sustained": lambda s, d: alerts.sustained_alerts(r(s, d), star.alert_rules(s, RULES)),
        "alert_rules_by_robot": lambda s, d: alerts.sustained_alerts(
            r(s, d), star.alert_rules(s, RULES), keys=["robot_id"], chunk_seconds=86400),
        "alert_rules_indexed": lambda s, d: rule_index.indexed_alerts(r(s, d), star.part_rules(s, d), keys=["robot_id"]),
        "alert_rules_indexed_chunked": lambda s, d: rule_index.indexed_alerts(
            r(s, d), star.part_rules(s, d), keys=["robot_id"], chunk_seconds=10 * 86400, busy_rows=0),
        "alert_records": lambda s, d: alerts.alert_records(alerts.sustained_alerts(
            r(s, d), star.alert_rules(s, RULES), keys=["robot_id"])).select(
            "rule_id", "robot_id", "title", "content", "severity", "status", "create_time"),
        "alert_rules_battery": lambda s, d: alerts.sustained_alerts(
            star.status_history(s, d), star.alert_rules(s), keys=["robot_id"], metrics=("battery_level",)),
        "alert_rules_chunked": lambda s, d: alerts.sustained_alerts(
            r(s, d), star.alert_rules(s, RULES), keys=["robot_id"], chunk_seconds=6 * 3600, busy_rows=0),
        # rows
        "realtime_topn": lambda s, d: raw.newest(r(s, d), 50, columns=["data_id", "event_time", "robot_id", "sensor_type"]),
        "range_query": lambda s, d: rounded(raw.time_range(r(s, d), LOW, HIGH).select(
            "data_id", "event_time", "robot_id", "temperature", "position_z")),
        "page_query": lambda s, d: raw.page(
            r(s, d).select("data_id", "event_time", "robot_id"), ["event_time", "data_id"], 3, 20),
        "page_deep": lambda s, d: raw.page_by_position(
            r(s, d).select("data_id", "event_time", "robot_id"), ["event_time", "data_id"], 30, 20),
        "page_with_nulls": lambda s, d: raw.page_by_position(
            r(s, d).select("temperature", "data_id"), ["temperature", "data_id"], 30, 20),
        "latest_reading": lambda s, d: raw.latest_per_robot(r(s, d)).select("robot_id", "data_id", "event_time", "sensor_id"),
        "robot_sensor_latest": lambda s, d: rounded(raw.robot_sensor_latest(
            st(s, d), star.dim_robot(s, d), r(s, d), star.dim_sensor(s, d))),
        "sample_random": lambda s, d: raw.sample_random(r(s, d), 100, seed=3).select("data_id", "robot_id"),
        "sample_systematic": lambda s, d: raw.sample_systematic(
            r(s, d).select("data_id", "event_time", "robot_id"), ["event_time", "data_id"], 90),
        "sample_routed": lambda s, d: rounded(raw.sample_systematic(_routed(s, d), ["robot_id"], 7)),
        "sample_head": lambda s, d: raw.sample_head(r(s, d), ["event_time", "data_id"], 90).select("data_id", "event_time"),
        "access_log_page": lambda s, d: raw.page(
            star.operation_log(s, d), ["create_time", "log_id"], 2, 50, descending=True),
        "backup_task_page": lambda s, d: raw.page(
            star.backup_tasks(s, d), ["start_time", "task_id"], 1, 25, first_page=0, descending=True).drop("total", "pages"),
        "sensor_types": lambda s, d: raw.sensor_types(r(s, d)),
        # robots and commands
        "active_robots": lambda s, d: robots.active_robots(star.dim_robot(s, d)).select("robot_id", "robot_name", "location"),
        "status_by_ids": q_status_by_ids,
        "online_robots": lambda s, d: robots.online_robots(st(s, d)),
        "robot_status_counts": lambda s, d: robots.status_counts(st(s, d)),
        "command_status_counts": lambda s, d: robots.status_counts(cmd(s, d)),
        "system_totals": lambda s, d: robots.system_totals(st(s, d), cmd(s, d)),
        "commands_by_type": lambda s, d: monitoring.counter(cmd(s, d), "command_type"),
        "command_history": lambda s, d: robots.command_history(cmd(s, d)).select(
            "robot_id", "command_id", "create_time", "position"),
        "command_latest": lambda s, d: robots.command_latest(star.command_events(s, d)),
        "command_transitions": lambda s, d: robots.command_transitions(star.command_events(s, d)),
        "retry_eligible": lambda s, d: robots.retry_eligible(cmd(s, d)).select("command_id", "status", "retry_count", "can_retry"),
        "cancellable": lambda s, d: robots.cancellable(cmd(s, d)).select("command_id"),
        "task_status_after": lambda s, d: robots.task_status(cmd(s, d), st(s, d)),
        "command_duration": lambda s, d: robots.command_durations(cmd(s, d)),
        "robot_latest_status": lambda s, d: robots.latest_status(r(s, d), NOW, 6 * 3600),
        "robot_latest_status_all": lambda s, d: robots.latest_status(
            r(s, d).filter("sensor_type = 'PRESSURE'"), NOW, 6 * 3600, star.dim_robot(s, d)),
        "robot_dim_upsert": q_robot_updates,
        "reading_tags": lambda s, d: robots.reading_tags(r(s, d)),
        "reading_tags_attached": lambda s, d: robots.reading_tags(r(s, d), r(s, d).filter(
            "sensor_type = 'NOISE' OR humidity < 50").selectExpr("data_id", "if(humidity < 20, 'mine', 'batch') AS tag")),
        "subscription_match": lambda s, d: robots.subscription_matches(r(s, d), star.subscriptions(s, d)),
        "status_topics": q_status_topics, "alert_topics": q_alert_topics, "command_topics": q_command_topics,
        # validation, messages, functions
        "id_format_check": q_id_format_check, "json_validity": q_json_validity,
        "validate_stream": q_validate_stream, "validate_http": q_validate_http,
        "collect_counts": q_collect_counts, "topic_routing": q_topic_routing, "metric_map": q_metric_map,
        "dim_time": q_dim_time, "partition_values": q_partition_values,
        # monitoring
        "system_performance": lambda s, d: monitoring.system_performance(r(s, d), NOW),
        "system_performance_month": lambda s, d: monitoring.system_performance(r(s, d), NOW, hours=24 * 31),
        "readings_by_type": lambda s, d: monitoring.readings_by_type(r(s, d)),
        "type_share": lambda s, d: rounded(monitoring.type_share(r(s, d))),
        "rows_per_second": lambda s, d: monitoring.rows_per_second(r(s, d)),
        "anomalies_per_hour": lambda s, d: monitoring.anomalies_per_hour(r(s, d)),
        "run_success_rates": lambda s, d: rounded(monitoring.job_rates(star.run_log(s, d))),
        "message_rates": q_message_rates, "command_timers": q_command_timers,
        "compression_statistics": lambda s, d: rounded(monitoring.compression_statistics(star.compression_tasks(s, d))),
        "backup_statistics": lambda s, d: monitoring.backup_statistics(star.backup_tasks(s, d)),
        "backup_report": lambda s, d: monitoring.backup_report(
            star.backup_tasks(s, d), datetime(1996, 1, 1), datetime(2001, 1, 1)),
        # lifecycle
        "retention_keep": lambda s, d: retention.kept(r(s, d), datetime(2024, 1, 16)).select("data_id", "event_time"),
        "retention_delete": q_retention_delete,
        "cleanup_preview": lambda s, d: retention.cleanup_preview(r(s, d), datetime(2024, 1, 16)),
        "storage_stats": lambda s, d: rounded(retention.storage_stats(r(s, d))),
        "incremental_delta": lambda s, d: backup.incremental_delta(r(s, d), datetime(2024, 1, 20)).select("data_id", "event_time"),
        "checksum_differences": q_checksum_differences,
        "table_checksum": lambda s, d: backup.digest_counts(r(s, d)),
        "backup_restore": q_backup_restore, "backup_changed": q_backup_changed,
        "partitioned_write": q_partitioned_write, "bucketed_read": q_bucketed_read,
        "compress_rewrite": q_compress_rewrite, "compress_in_place": q_compress_in_place,
        # streams, run to the end of the files that are there
        "stream_ingest": lambda s, d: rounded(ingest.ingested(s, _ingested(s, d)).select(
            "data_id", "event_time", "robot_id", "sensor_type", "temperature", "humidity", "pressure")),
        "stream_ingest_metrics": lambda s, d: rounded(ingest.ingested(s, _ingested(s, d), "metrics").select(
            "data_id", F.explode("metrics").alias("metric", "value"))),
        "stream_compacted": q_stream_compacted,
        "stream_quarantine": lambda s, d: ingest.quarantine(s, _ingested(s, d)).groupBy("reason").agg(F.count("*").alias("n")),
        "stream_stats": lambda s, d: rounded(ingest.processing_stats(s, _ingested(s, d)).select(
            "total_processed", "total_errors", "success_rate")),
        "stream_dedup": q_stream_dedup,
        "stream_windows": q_stream_windows,
        "stream_status": q_stream_status, "stream_status_events": q_stream_status_events,
        "stream_sustained": lambda s, d: q_stream_sustained(s, d).select("rule_id", "robot_id", "start_time", "severity"),
        "stream_sustained_late": lambda s, d: q_stream_sustained_late(s, d).select("rule_id", "robot_id", "start_time", "severity"),
    }


def oracle_sql() -> dict[str, str]:
    return {**ORACLE, **LLM_ORACLES, **({"pipeline": PIPELINE_SQL} if PIPELINE_SQL else {})}


def entry(spark: SparkSession) -> DataFrame:
    """Averages and extremes per robot over the whole month."""
    return queries()["route_realtime"](spark, "/root/testdata/sf0.001")
