"""Sustained alerts over readings that come out of order."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantpulse.operators import alerts
from plantpulse.operators.ordered import CHUNK
from plantpulse.schemas import ALERT_RULE, SEED_RULES
from plantpulse.streaming import alerts as stream_alerts

T0 = datetime(2024, 1, 5, 10)


def rules(spark):
    return spark.createDataFrame(SEED_RULES, ALERT_RULE)


def at(readings, *seconds, temperature=90.0, **k):
    return readings(*[{"data_id": f"x{s}", "event_time": T0 + timedelta(seconds=s), "temperature": temperature, **k} for s in seconds])


def starts(spark, folder):
    return sorted((x.start_time - T0).total_seconds() for x in stream_alerts.raised(spark, folder).collect())


def test_a_late_reading_breaks_the_run(spark, readings, folder):
    """In time order 0 to 200 breach, 250 does not, 300 to 700 do: only the second run lasts 300 s."""
    write = stream_alerts.sustained_writer(rules(spark), folder, delay_seconds=200)
    write(at(readings, 0, 200, 400), 0)
    write(at(readings, 250, temperature=20.0), 1)
    write(at(readings, 700, 300), 2)
    assert starts(spark, folder) == []
    write(at(readings, 950, temperature=20.0), 3)
    write(at(readings, 950, temperature=20.0), 3)
    assert starts(spark, folder) == [300]


def test_too_late_and_timeless_readings_go_to_the_side(spark, readings, folder):
    write = stream_alerts.sustained_writer(rules(spark), folder, delay_seconds=100)
    write(at(readings, 500, 1000), 0)
    write(at(readings, 900, 899, 901).unionByName(readings({"event_time": None, "data_id": "none", "temperature": 99.0})), 1)
    assert sorted(r.data_id for r in stream_alerts.too_late(spark, folder).collect()) == ["none", "x899", "x900"]
    assert [r.data_id for r in spark.read.parquet(f"{folder}/waiting/batch_id=1").orderBy("event_time").collect()] == ["x901", "x1000"]


def test_only_late_or_no_readings(spark, readings, folder):
    write = stream_alerts.sustained_writer(rules(spark), folder, delay_seconds=100)
    write(readings({"event_time": None}), 0)
    write(at(readings, 0).limit(0), 1)
    write(at(readings, 0, 400), 2)
    stream_alerts.finish_sustained(spark, rules(spark), folder)
    assert starts(spark, folder) == [0]


def test_a_stream_that_goes_on_replaces_the_finish(spark, readings, folder):
    write = stream_alerts.sustained_writer(rules(spark), folder, delay_seconds=400)
    write(at(readings, 0, 350), 0)
    stream_alerts.finish_sustained(spark, rules(spark), folder)
    stream_alerts.finish_sustained(spark, rules(spark), folder)
    assert starts(spark, folder) == [0]
    write(at(readings, 100, temperature=20.0), 1)
    assert starts(spark, folder) == []
    stream_alerts.finish_sustained(spark, rules(spark), folder)
    assert starts(spark, folder) == []


def test_shuffled_readings_equal_the_batch(spark, sf, folder):
    from plantpulse.sources import star
    r = star.readings(spark, sf)
    came = F.col("event_time") + F.make_dt_interval(hours=(F.crc32("data_id") % 47).cast("int"))
    edges = [datetime(2024, 1, 1) + timedelta(days=d) for d in (0, 9, 14, 22, 40)]
    write = stream_alerts.sustained_writer(rules(spark), folder, ["robot_id"], delay_seconds=2 * 86400)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        write(r.filter((came >= F.lit(a)) & (came < F.lit(b))), i)
    stream_alerts.finish_sustained(spark, rules(spark), folder, ["robot_id"])
    got = sorted((x.rule_id, x.robot_id, x.start_time) for x in stream_alerts.raised(spark, folder).collect())
    want = sorted((x.rule_id, x.robot_id, x.start_time) for x in alerts.sustained_alerts(r, rules(spark), ["robot_id"]).collect())
    assert got == want and want
    assert stream_alerts.too_late(spark, folder).count() == 0


def test_readings_move_before_they_meet_rules(spark, readings, folder, monkeypatch):
    seen, judged = [], stream_alerts.judged
    monkeypatch.setattr(stream_alerts, "judged", lambda rows, *a: seen.append(rows.columns) or judged(rows, *a))
    stream_alerts.sustained_writer(rules(spark), folder)(at(readings, 0, 400), 0)
    assert starts(spark, folder) == [0] and all(CHUNK in columns and "position_x" not in columns for columns in seen) and seen
