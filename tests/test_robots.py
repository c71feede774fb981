import json
from datetime import datetime, timedelta

import pytest

from plantpulse.operators import alerts, monitoring, robots
from plantpulse.schemas import ALERT_RULE, SEED_RULES, SUBSCRIPTION

T0 = datetime(2024, 1, 5, 10)


def rules(spark, *extra):
    return spark.createDataFrame([*SEED_RULES, *extra], ALERT_RULE)


def at(s, **k):
    return {"event_time": T0 + timedelta(seconds=s), **k}


def test_seed_rules_parse(spark):
    parsed = {r.rule_id: r for r in alerts.parsed_rules(rules(spark)).collect()}
    assert (parsed["RULE001"].operator, parsed["RULE001"].threshold, parsed["RULE001"].duration) == (">", 80.0, 300)
    assert parsed["RULE002"].operator == "<"


def test_alert_island(spark, readings):
    hot = [at(s, temperature=81.0) for s in (0, 100, 299)] + [at(310, temperature=20.0)]
    hot += [at(s, temperature=90.0) for s in (400, 500, 700)] + [at(550), at(560, temperature=float("nan"))]
    got = alerts.sustained_alerts(readings(*hot), rules(spark), chunk_seconds=60, busy_rows=0).collect()
    assert [(r.rule_id, r.start_time, r.lasted_seconds, r.readings) for r in got] == [
        ("RULE001", T0 + timedelta(seconds=400), 300, 3)]
    record = alerts.alert_records(alerts.sustained_alerts(readings(*hot), rules(spark))).first()
    assert (record.robot_id, record.severity, record.status, record.content) == ("R001", "HIGH", "ACTIVE", "held for 300 s")


def test_other_operators_and_switched_off_rules(spark, readings):
    def rule(i, op, limit, on=1):
        return (i, "", "X", "", json.dumps({"metric": "humidity", "operator": op, "threshold": limit, "duration": 0}), "{}", "LOW", on)

    r = readings(at(0, humidity=10.0))
    got = alerts.sustained_alerts(r, rules(spark, rule("A", ">=", 10), rule("B", "<=", 10), rule("C", "=", 10), rule("D", "<", 10),
                                           rule("E", "=", 10, 0), rule("F", "!=", 0)))
    assert sorted(x.rule_id for x in got.collect()) == ["A", "B", "C"]


def test_command_history_and_retry(spark):
    rows = [(f"c{i}", "R1" if i % 3 else "R2", T0 + timedelta(seconds=i), "FAILED", i % 4, 3) for i in range(9)]
    c = spark.createDataFrame(rows, "command_id string, robot_id string, create_time timestamp_ntz, status string, retry_count int, max_retry int")
    assert [r.command_id for r in robots.command_history(c, 2, "R1").collect()] == ["c8", "c7"]
    assert sorted(r.command_id for r in robots.command_history(c, 2).collect()) == ["c3", "c6", "c7", "c8"]
    can = {r.retry_count: r.can_retry for r in robots.retry_eligible(c).collect()}
    assert can == {0: True, 1: True, 2: True, 3: False}
    assert robots.command_by_id(c, "c3").count() == 1


def test_transitions(spark):
    log = [("a", "PENDING"), ("a", "FAILED"), ("a", "RETRYING"), ("a", "EXECUTED"), ("a", "PENDING"), ("b", "EXECUTED")]
    e = spark.createDataFrame([(c, T0 + timedelta(days=i * 20), i, s) for i, (c, s) in enumerate(log)],
                              "command_id string, event_time timestamp_ntz, event_seq int, status string")
    got = [(r.previous_status, r.status, r.legal) for r in robots.command_transitions(e, 86400, busy_rows=0).orderBy("event_seq").collect()]
    assert got == [(None, "PENDING", True), ("PENDING", "FAILED", True), ("FAILED", "RETRYING", True),
                   ("RETRYING", "EXECUTED", True), ("EXECUTED", "PENDING", False), (None, "EXECUTED", False)]
    assert {r.command_id: r.status for r in robots.command_latest(e).collect()} == {"a": "PENDING", "b": "EXECUTED"}


def test_stale_status(spark):
    h = spark.createDataFrame([("R1", "x", T0 - timedelta(seconds=31), "ONLINE"), ("R2", "x", T0 - timedelta(seconds=30), "ONLINE"),
                               ("R2", "y", T0 - timedelta(seconds=60), "FAULT")],
                              "robot_id string, data_id string, event_time timestamp_ntz, status string")
    assert {r.robot_id: r.status for r in robots.latest_status(h, T0).collect()} == {"R1": "OFFLINE", "R2": "ONLINE"}


def test_silent_robots_are_offline(spark):
    h = spark.createDataFrame([("R1", "x", T0, "ONLINE")], "robot_id string, data_id string, event_time timestamp_ntz, status string")
    known = spark.createDataFrame([("R1",), ("R9",)], "robot_id string")
    assert {r.robot_id: r.status for r in robots.latest_status(h, T0, robots=known).collect()} == {"R1": "ONLINE", "R9": "OFFLINE"}


def test_upsert(spark):
    dim = spark.createDataFrame([("R1", "one", 1, "A", T0), ("R2", "two", 1, "B", T0)],
                                "robot_id string, robot_name string, status int, location string, update_time timestamp_ntz")
    later = T0 + timedelta(days=1)
    upd = spark.createDataFrame([("R1", 0, "C", T0), ("R1", 1, "D", later), ("R9", 1, "Z", later)],
                                "robot_id string, status int, location string, update_time timestamp_ntz")
    assert sorted(map(tuple, robots.upsert_robots(dim, upd).collect())) == [("R1", "one", 1, "D", later), ("R2", "two", 1, "B", T0)]


def test_tags(spark, readings):
    r = readings({"temperature": 150.0, "status": "ABNORMAL"}, {})
    tags = robots.derived_tags(r)
    twice = tags.unionByName(tags)
    got = {x.data_id: x.tags for x in robots.tagged(r, twice).collect()}
    assert got == {"d000": "anomaly,critical,raw", "d001": "raw"}


def test_unknown_tags_stay(spark, readings):
    r = readings({"temperature": 150.0}, {}, {})
    extra = spark.createDataFrame([("d000", "mine"), ("d000", "mine"), ("d000", "raw"), ("d001", "zeta"), ("d001", "batch"), ("d001", None)],
                                  "data_id string, tag string")
    got = {x.data_id: x.tags for x in robots.reading_tags(r, extra).collect()}
    assert got == {"d000": "critical,raw,mine", "d001": "batch,raw,zeta", "d002": "raw"}
    assert "Exchange" not in robots.reading_tags(r)._jdf.queryExecution().executedPlan().toString()
    assert {x.data_id: x.tags for x in robots.tags_per_reading(extra).collect()} == {"d000": "raw,mine", "d001": "batch,zeta"}


def test_subscriptions(spark, readings):
    r = readings({"robot_id": "R1", "sensor_type": "NOISE"}, {"robot_id": "R2", "sensor_type": "PRESSURE"})
    s = spark.createDataFrame([("all", "u", None, None), ("empty", "u", [], []), ("r1", "u", ["R1", "R1"], None), ("p", "u", None, ["PRESSURE"]),
                               ("none", "u", ["R1"], ["PRESSURE"]), ("both", "u", ["R1", "R2"], ["NOISE", "PRESSURE"])], SUBSCRIPTION)
    got = sorted(map(tuple, robots.subscription_matches(r, s).collect()))
    assert got == [("all", "d000"), ("all", "d001"), ("both", "d000"), ("both", "d001"), ("empty", "d000"), ("empty", "d001"),
                   ("p", "d001"), ("r1", "d000")]


def test_messages(spark):
    st = spark.createDataFrame([("R1", "ONLINE")], "robot_id string, status string")
    got = {r.topic: json.loads(r.value) for r in robots.status_messages(st).collect()}
    assert set(got) == {"/topic/robots/R1/status", "/topic/robots/all/status"}
    assert got["/topic/robots/all/status"] == {"robot_id": "R1", "status": "ONLINE"}
    assert robots.command_messages(st).first().topic == "/topic/robots/R1/commands"
    assert {r.topic for r in robots.alert_messages(st).collect()} == {"/topic/robots/R1/alerts", "/topic/alerts"}


def test_rates_without_rows(spark):
    runs = spark.createDataFrame([], "status string, records long, failed_records long")
    assert monitoring.job_rates(runs).first()[:] == (0, 0, 0, 0, 0, 0.0, 0.0)
    tasks = spark.createDataFrame([], "status string, compressed_files long, original_size long, compressed_size long")
    assert monitoring.compression_statistics(tasks).first()[:] == (0, 0, 0, 0.0)
    assert monitoring.message_rates(spark.createDataFrame([], "acked boolean")).first()[:] == (0, 0, 0, 0.0)


def test_backup_figures(spark):
    t = spark.createDataFrame([("FULL_BACKUP", "COMPLETED", T0, T0 + timedelta(1), 10, 1), ("INCREMENTAL_BACKUP", "FAILED", T0 + timedelta(2), None, 5, 2)],
                              "task_type string, status string, start_time timestamp_ntz, end_time timestamp_ntz, backup_size long, file_count long")
    s = monitoring.backup_statistics(t).first()
    assert (s.total_size, s.total_count, s.full_backups, s.incremental_backups, s.average_size) == (15, 2, 1, 1, 7)
    assert monitoring.backup_report(t, T0, T0 + timedelta(3)).first()[:] == (1, 5, 2, 0, 1)  # the start is outside
    files = spark.createDataFrame([("a", 8)], "path string, bytes long")
    assert monitoring.backup_statistics(t, files).first().total_size == 8


@pytest.mark.parametrize("limit,flag", [(1, True), (2, False)])
def test_anomalies_per_hour(readings, limit, flag):
    r = readings({"temperature": 101.0}, {"temperature": -0.1}, {"temperature": 100.0}, {"temperature": float("nan")}, {})
    row = monitoring.anomalies_per_hour(r, limit).first()
    assert (row.n, row.flagged) == (2, flag)


def test_performance_window(readings):
    r = readings({"event_time": T0, "temperature": 1.0}, {"event_time": T0 - timedelta(hours=24), "sensor_id": "S2"},
                 {"event_time": T0 - timedelta(hours=24, seconds=1)})
    row = monitoring.system_performance(r, T0).first()
    assert (row.total_records, row.unique_robots, row.unique_sensors, row.avg_temperature, row.avg_humidity) == (2, 1, 2, 1.0, None)
