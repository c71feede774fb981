import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import alerts
from plantpulse.schemas import ALERT_RULE, MANUAL_TOPIC, SEED_RULES
from plantpulse.sources import messages, streams
from plantpulse.streaming import alerts as stream_alerts, ingest, status

T0 = datetime(2024, 1, 5, 10)


def write_text(spark, path, *lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def message(i, **k):
    body = {"data_id": f"d{i}", "robot_id": "R1", "sensor_id": "S1", "sensor_type": "NOISE", "event_time": "2024-01-05T10:00:00",
            "metrics": {"temperature": 20.0}, "status": "NORMAL", **k}
    return json.dumps(body)


def test_ingest_and_restart(spark, folder):
    source, target, mark = (f"{folder}/{x}" for x in ("in", "out", "mark"))

    def run():
        q = ingest.start_ingest(streams.text_stream(spark, source, 1), target, mark, available_now=True)
        q.awaitTermination()

    write_text(spark, source, message(1), "{bad", message(2, metrics={"temperature": 151.0}), message(3, metrics=None))
    run()
    write_text(spark, source, message(4), message(5, robot_id=None))
    run()
    run()
    assert sorted(r.data_id for r in ingest.ingested(spark, target).collect()) == ["d1", "d3", "d4"]
    reasons = sorted(r.reason for r in ingest.quarantine(spark, target).collect())
    assert reasons == ["not JSON", "robot_id missing", "temperature out of range"]
    s = ingest.processing_stats(spark, target).first()
    assert (s.total_processed, s.total_errors, s.last_batch_size, s.success_rate) == (6, 3, 2, 50.0)


def test_replayed_batch_replaces_its_output(spark, folder):
    write = ingest.ingest_writer(folder)
    rows = spark.createDataFrame([(message(1),)], "value string")
    write(rows, 0)
    write(rows, 0)
    assert ingest.ingested(spark, folder).count() == 1 and ingest.processing_stats(spark, folder).first().total_processed == 1


def stream_of(spark, df, path):
    """The rows as one file per row group, oldest first, read back as a stream."""
    df.write.parquet(path)
    return streams.parquet_stream(spark, path, df.schema, 1)


def test_dedup(spark, readings, folder):
    r = readings({"data_id": "a", "event_time": T0}, {"data_id": "a", "event_time": T0 + timedelta(minutes=5)},
                 {"data_id": "b", "event_time": T0})
    got = ingest.collect_stream(ingest.deduplicated(stream_of(spark, r, folder + "/in")), folder + "/run")
    assert sorted(x.data_id for x in got.collect()) == ["a", "b"]
    assert dict(got.dtypes)["event_time"] == "timestamp_ntz"


def test_windows_equal_batch(spark, sf, folder):
    from plantpulse.sources import star
    r = star.readings(spark, sf)
    live = ingest.windowed_metrics(stream_of(spark, r.repartition(5), folder + "/in"))
    got = ingest.collect_stream(live, folder + "/run", "complete")
    want = ingest.windowed_metrics(r)

    def rows(df):
        return {(x.window_start, x.sensor_type, x.n, round(x.avg_temperature or 0, 6)) for x in df.collect()}

    assert rows(got) == rows(want)


def rules(spark):
    return spark.createDataFrame(SEED_RULES, ALERT_RULE)


def test_sustained_across_batches(spark, readings, folder):
    """The condition starts in one batch, lasts over a silent one and is reported once."""
    write = stream_alerts.sustained_writer(rules(spark), folder)

    def at(*seconds, temperature=90.0, **k):
        return readings(*[{"data_id": f"x{s}", "event_time": T0 + timedelta(seconds=s), "temperature": temperature, **k} for s in seconds])

    write(at(0, 100), 0)
    write(at(0, robot_id="R002"), 1)
    write(at(200, 299), 2)
    assert stream_alerts.raised(spark, folder).count() == 0
    write(at(310), 3)
    write(at(400, 500), 4)
    assert [(x.robot_id, x.start_time, x.raised_at) for x in stream_alerts.raised(spark, folder).collect()] == [
        ("R001", T0, T0 + timedelta(seconds=310))]
    write(at(600, temperature=20.0), 5)
    write(at(700, 1000), 6)
    write(at(700, 1000), 6)
    starts = sorted(x.start_time for x in stream_alerts.raised(spark, folder).filter("robot_id = 'R001'").collect())
    assert starts == [T0, T0 + timedelta(seconds=700)]


def test_sustained_stream_equals_batch(spark, sf, folder):
    from plantpulse.sources import star
    r = star.readings(spark, sf)
    edges = [datetime(2024, 1, 1) + timedelta(days=d) for d in (0, 9, 14, 22, 31)]
    write = stream_alerts.sustained_writer(rules(spark), folder, ["robot_id"])
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        write(r.filter((F.col("event_time") >= F.lit(a)) & (F.col("event_time") < F.lit(b))), i)
    got = {(x.rule_id, x.robot_id, x.start_time) for x in stream_alerts.raised(spark, folder).collect()}
    want = {(x.rule_id, x.robot_id, x.start_time) for x in alerts.sustained_alerts(r, rules(spark), ["robot_id"]).collect()}
    assert got == want and want


def test_status_stream(spark, readings, folder):
    r = readings({"event_time": T0, "status": "NORMAL"}, {"event_time": T0 + timedelta(seconds=9), "status": "ABNORMAL"},
                 {"robot_id": "R002", "event_time": T0})
    q = status.start_status(stream_of(spark, r.repartition(3), folder + "/in"), folder + "/out", folder + "/mark", available_now=True)
    q.awaitTermination()
    got = {x.robot_id: x.status for x in status.current_status(spark, folder + "/out", T0 + timedelta(seconds=35)).collect()}
    assert got == {"R001": "ABNORMAL", "R002": "OFFLINE"}


def test_status_snapshots(spark, folder):
    write = status.status_writer(folder, every=2)
    for i in range(6):
        write(spark.createDataFrame([(f"R{i % 2}", f"S{i}", T0 + timedelta(seconds=i))],
                                    "robot_id string, reported_status string, last_update_time timestamp_ntz"), i)
        if i == 4:
            write(spark.createDataFrame([("R0", "S4", T0 + timedelta(seconds=4))],
                                        "robot_id string, reported_status string, last_update_time timestamp_ntz"), 4)
    got = {x.robot_id: x.status for x in status.current_status(spark, folder, T0, 30).collect()}
    assert got == {"R0": "S4", "R1": "S5"}
    assert {x.robot_id for x in spark.read.parquet(folder + "/snapshots/batch_id=4").collect()} == {"R0", "R1"}


def test_robot_alert_stream(spark, folder):
    st = spark.createDataFrame([("R1", "one", "ONLINE", "IDLE", 90.0, 50.0, {"a": 1.0}), ("R2", "two", "ONLINE", "IDLE", 20.0, 50.0, {"a": 1.0})],
                               "robot_id string, robot_name string, status string, task_status string, temperature double, battery_level double, sensor_data map<string,double>")
    got = ingest.collect_stream(stream_alerts.robot_alert_messages(stream_of(spark, st, folder + "/in")), folder + "/run")
    assert {(x.topic, json.loads(x.value)["severity"]) for x in got.collect()} == {("/topic/alerts", "MEDIUM"), ("/topic/robots/R1/alerts", "MEDIUM")}


def test_topic_stream(spark, readings, folder):
    from plantpulse.sinks import topics
    live = stream_of(spark, readings({}, {"sensor_type": ""}), folder + "/in")
    got = ingest.collect_stream(messages.topic_rows(messages.to_events(live)), folder + "/run")
    assert {x.topic for x in got.collect()} == {"sensor-data-temperature", "sensor-data-general"}
    topics.to_files(got, folder + "/topics")
    assert spark.read.json(folder + "/topics").count() == 2


def test_kafka_options():
    o = streams.kafka_options("h:1", [MANUAL_TOPIC])
    assert o["subscribe"] == MANUAL_TOPIC and o["startingOffsets"] == "earliest" and o["kafka.isolation.level"] == "read_committed"
    assert streams.kafka_options("h:1", pattern="sensor-data-.*")["subscribePattern"] == "sensor-data-.*"


def test_stream_failure_is_reported(spark, folder, readings):
    live = stream_of(spark, readings({}), folder + "/in")

    def fail(batch, batch_id):
        raise RuntimeError("sink down")

    with pytest.raises(Exception, match="sink down"):
        ingest.run_to_end(live.writeStream.foreachBatch(fail).option("checkpointLocation", folder + "/mark"))


def test_compaction_survives_a_break(spark, sf, folder):
    from plantpulse.session import move_path, path_exists
    from plantpulse.streaming import compact
    from __spark_entry__ import _message_stream

    query = ingest.start_ingest(_message_stream(spark, sf), folder, f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    want = sorted(r.data_id for r in ingest.ingested(spark, folder).collect())
    bad = ingest.quarantine(spark, folder).count()
    stored = f"{folder}/rows/batch_id=0/outcome=accepted"
    move_path(spark, stored, f"{folder}/kept")
    move_path(spark, f"{folder}/kept", stored)
    assert compact.compact(spark, folder) == 1 and not path_exists(spark, stored)
    assert sorted(r.data_id for r in compact.facts(spark, folder).collect()) == want
    spark.createDataFrame([], ingest.READINGS).write.parquet(stored)  # as if the removal had not happened
    assert compact.compact(spark, folder) == 0 and not path_exists(spark, stored)
    assert sorted(r.data_id for r in compact.facts(spark, folder).collect()) == want
    assert ingest.quarantine(spark, folder).count() == bad


def test_bucketed_read_has_no_shuffle(spark, sf):
    from __spark_entry__ import queries

    plan = queries()["bucketed_read"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
