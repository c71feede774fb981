from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plantpulse.functions import health, mask, metrics, text, timefn, validate
from plantpulse.schemas import READING_EVENT
from plantpulse.sources import messages


def one(spark, column, schema, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_weeks(spark):
    days = (date(2024, 12, 30), date(2023, 1, 1), date(2021, 1, 4))
    assert one(spark, timefn.iso_week("d"), "d date", *days) == ["2025-01", "2022-52", "2021-01"]
    assert one(spark, timefn.week_monday_first("d"), "d date", *days) == [53, 0, 1]


def test_strict_time(spark):
    got = one(spark, timefn.parse_strict("s"), "s string", "2024-01-01 10:00:00", "2024-01-01T10:00:00", "x", None)
    assert got == [datetime(2024, 1, 1, 10), None, None, None]


def test_dim_time(spark):
    rows = timefn.minutes_from(spark, datetime(2024, 1, 1), 1000, datetime(2024, 1, 31, 23, 59, 59)).orderBy("time_key").collect()
    assert len(rows) == 1000 and rows[-1].time_key == 20240101163900
    assert (rows[0].week_of_year, rows[0].day_of_week, rows[0].is_weekend, rows[0].quarter) == (1, 2, False, 1)
    assert timefn.minutes_from(spark, datetime(2024, 1, 31, 23, 58), 10, datetime(2024, 1, 31, 23, 59, 59)).count() == 2


def test_partition_values(spark):
    t = datetime(2024, 3, 4, 5)
    for kind, want in (("daily", "2024-03-04"), ("hourly", "2024-03-04-05"), ("monthly", "2024-03"), ("?", "2024-03-04")):
        assert one(spark, timefn.partition_value("t", kind), "t timestamp_ntz", t) == [want]


def test_json_validity(spark):
    docs = ('{"a": 1}', '[1, 2]', '1', '{bad', '"k": 1}', '1, 2', '1, "end": 7', '', '{"a": 1} x', None)
    want = [True, True, True] + [False] * 7
    assert one(spark, text.json_valid("s"), "s string", *docs) == want
    assert one(spark, text.json_object("s"), "s string", *docs) == [True] + [False] * 9
    assert one(spark, text.json_array("s"), "s string", *docs) == [False, True] + [False] * 8


def test_text(spark):
    assert one(spark, text.capitalised("s"), "s string", "tEMP", "", None) == ["Temp", "", None]
    assert one(spark, text.digits_only_time("s"), "s string", "2024-01-02 03:04:05") == ["20240102030405"]
    assert one(spark, text.topic_of("s"), "s string", "NOISE", "", None) == [
        "sensor-data-noise", "sensor-data-general", "sensor-data-general"]


def test_round_half(spark):
    assert one(spark, mask.rounded(F.col("x")), "x double", 2.5, -2.5, None) == [3, -2, None]


def test_desensitize(spark):
    df = spark.createDataFrame([("a", 10.0, 7, 1.0), (None, None, 8, 2.0)], "s string, x double, i int, n double")
    out = mask.desensitize(df, {"s": "MASK", "x": "ROUND", "i": "ROUND", "n": "NOISE", "zzz": "MASK"}, seed=1).collect()
    assert (out[0].s, out[0].x, out[0].i) == ("***", 10, 7)
    assert out[1].s is None and out[1].x is None
    assert all(abs(o.n / w - 1) <= 0.05 for o, w in zip(out, (1.0, 2.0)))


def test_stream_ranges(spark):
    def reason(m):
        df = spark.createDataFrame([("d", "r", "s", "t", datetime(2024, 1, 1), m)],
                                   "data_id string, robot_id string, sensor_id string, sensor_type string, event_time timestamp_ntz, metrics map<string,double>")
        return df.select(validate.stream_reason()).first()[0]

    for ok in ({"temperature": -50.0}, {"temperature": 150.0}, {"humidity": 100.0}, {"pressure": 500.0}, {"pressure": 1500.0}, {}, None):
        assert reason(ok) is None
    assert reason({"temperature": 150.1}) == "temperature out of range"
    assert reason({"pressure": 1500.1}) == "pressure out of range"
    assert reason({"temperature": None}) == "temperature out of range"
    assert reason({"humidity": float("nan")}) == "humidity out of range"


def test_missing_fields(spark):
    df = spark.createDataFrame([(None, "r", "s", "t"), ("d", None, "s", "t"), ("d", "r", None, "t"), ("d", "r", "s", None)],
                               "data_id string, robot_id string, sensor_id string, sensor_type string")
    df = df.withColumns({"event_time": F.lit("2024-01-01").cast("timestamp_ntz"), "metrics": F.lit(None).cast("map<string,double>")})
    assert [r[0] for r in df.select(validate.stream_reason()).collect()] == [
        "data_id missing", "robot_id missing", "sensor_id missing", "sensor_type missing"]


@pytest.mark.parametrize("m,http,entity", [
    ({"t": 1.0}, True, True), ({}, True, False), (None, True, False), ({"t": None}, False, False),
    ({"t": float("nan")}, False, False), ({"t": float("inf")}, False, False), ({"t": float("-inf")}, False, False)])
def test_http_and_entity(spark, m, http, entity):
    df = spark.createDataFrame([("r", "s", "t", m, True)], "robot_id string, sensor_id string, sensor_type string, metrics map<string,double>, valid boolean")
    assert df.select(validate.http_valid(), validate.entity_valid()).first()[:] == (http, entity)
    assert df.withColumn("robot_id", F.lit("")).select(validate.http_valid()).first()[0] is False
    assert df.withColumn("valid", F.lit(False)).select(validate.entity_valid()).first()[0] is False


def test_identifiers(spark):
    assert one(spark, validate.robot_id_ok("s"), "s string", "R-1_#", "r1", "", None) == [True, False, False, False]
    assert one(spark, validate.sensor_type_ok("s"), "s string", "A_B", "A1") == [True, False]
    assert one(spark, validate.table_name_ok("s"), "s string", "t_1", "1t", "a;b") == [True, False, False]


def test_metric_map(spark):
    df = spark.createDataFrame([({"a": 1.0},), (None,)], "m map<string,double>")
    assert [r[0] for r in df.select(metrics.metric_value("m", "a")).collect()] == [1.0, None]
    changed = df.select(metrics.with_metric("m", "a", F.lit(5.0)), metrics.with_metric("m", "b", F.lit(6.0))).collect()
    assert [tuple(r) for r in changed] == [({"a": 5.0}, {"a": 1.0, "b": 6.0}), ({"a": 5.0}, {"b": 6.0})]


def test_robot_health(spark):
    rows = [
        ("no map", 120.0, 50.0, None), ("hot", 81.0, 50.0, {}), ("very hot", 101.0, 1.0, {}), ("flat", 20.0, 4.0, {}),
        ("low", 20.0, 9.0, {}), ("fine", 80.0, 10.0, {"motor_temperature": 100.0, "pressure": 1000.0}),
        ("map hot", 20.0, 50.0, {"motor_temperature": 100.5}), ("map low", 20.0, 50.0, {"oil_pressure": -1.0}),
        ("map other", 20.0, 50.0, {"speed": 5000.0})]
    df = spark.createDataFrame(rows, "id string, temperature double, battery_level double, sensor_data map<string,double>")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", health.severity(), health.description()).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "no map": "NORMAL", "hot": "MEDIUM", "very hot": "CRITICAL", "flat": "HIGH", "low": "MEDIUM", "fine": "NORMAL",
        "map hot": "MEDIUM", "map low": "MEDIUM", "map other": "NORMAL"}
    assert got["very hot"][1] == "Temperature too high: 101.0°C; Battery too low: 1.0%; "


def test_message_round_trip(spark, readings):
    r = readings({"temperature": 1.5, "position_x": 2.0, "event_time": datetime(2024, 1, 1, 1, 2, 3, 456789)}, {"humidity": 3.0})
    sent = messages.topic_rows(messages.to_events(r))
    assert {x.topic for x in sent.collect()} == {"sensor-data-temperature"} and sent.first().key == "R001#S001"
    parsed = messages.parse_messages(sent)
    back = messages.to_readings(parsed.filter("parse_error is null"))
    assert sorted(map(tuple, back.select(*r.columns).collect()), key=str) == sorted(map(tuple, r.collect()), key=str)
    assert set(f.name for f in READING_EVENT.fields) <= set(parsed.columns)


def test_bad_messages(spark):
    df = spark.createDataFrame([("{bad",), ("",), ('{"data_id":"a"}',), ("7",)], "value string")
    assert [x.parse_error for x in messages.parse_messages(df).collect()] == ["not JSON", "not JSON", None, "not JSON"]


def test_wall_clock_does_not_depend_on_the_zone(spark):
    """02:30 does not exist in New York on that day; it must keep its own hour and order here."""
    times = [datetime(2024, 3, 10, 1, 59, 59, 999999), datetime(2024, 3, 10, 2, 30, 15), datetime(2024, 3, 10, 3, 0)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(3).select(F.element_at(F.array(*[timefn.at(t) for t in times]), (F.col("id") + 1).cast("int")).alias("t"))
        assert [r[0].hour for r in df.select(timefn.truncated("t", "hour")).collect()] == [1, 2, 3]
        assert [str(r[0])[11:] for r in df.select(timefn.truncated("t", "second")).collect()] == ["01:59:59", "02:30:15", "03:00:00"]
        assert [str(r[0]) for r in df.select(timefn.truncated("t", "week")).distinct().collect()] == ["2024-03-04 00:00:00"]
        seconds = [r[0] for r in df.select(timefn.epoch_seconds("t")).collect()]
        assert [b - a for a, b in zip(seconds, seconds[1:])] == [1816, 1785]
        assert [r[0] for r in df.select(timefn.seconds_between(timefn.at(times[0]), "t")).collect()] == [0, 1815, 3600]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
