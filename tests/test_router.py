from datetime import datetime, timedelta

import pytest

from plantpulse.plans import router
from plantpulse.plans.rollup import build_hourly
from plantpulse.sources import star

T0 = datetime(2024, 1, 5, 10)
ALL = ["temperature", "humidity", "pressure"]


def tables(spark, r, robots=("R001",)):
    dim = spark.createDataFrame([(x, "name " + x, "WELDING") for x in robots], "robot_id string, robot_name string, robot_type string")
    return router.Tables(r, r, dim, build_hourly(r))


def test_bounds_are_inclusive(spark, readings):
    end = T0 + timedelta(minutes=5)
    r = readings(*[{"event_time": t} for t in (T0, end, T0 - timedelta(seconds=1), end + timedelta(seconds=1))])
    assert router.route_query(tables(spark, r), T0, end, metrics=ALL).first().data_count == 2


@pytest.mark.parametrize("span,tier", [
    (timedelta(minutes=5), "realtime"), (timedelta(minutes=5, seconds=1), "incremental"),
    (timedelta(minutes=1440), "incremental"), (timedelta(minutes=1441), "fallback"), (timedelta(seconds=-1), "empty")])
def test_tier_by_span(span, tier):
    assert router.tier_of(T0, T0 + span, ALL) == tier


def test_tier_by_metrics():
    end = T0 + timedelta(days=3)
    assert router.tier_of(T0, end, ["temperature", "HUMIDITY"]) == "rollup"
    assert router.tier_of(T0, end, ["temperature", "pressure"]) == "fallback"
    assert router.tier_of(T0, end, []) == "fallback"
    assert router.tier_of(T0, end, None) == "fallback"


def test_reversed_range_is_empty_with_the_usual_columns(spark, readings):
    t = tables(spark, readings({"event_time": T0}))
    out = router.route_query(t, T0, T0 - timedelta(hours=1), metrics=["temperature"])
    assert out.columns == ["robot_id", "avg_temperature", "max_temperature", "min_temperature", "data_count"]
    assert out.count() == 0


def test_robot_without_dimension_row(spark, readings):
    r = readings({"event_time": T0}, {"event_time": T0, "robot_id": "R999"})
    t = tables(spark, r)
    assert [x.robot_id for x in router.route_query(t, T0, T0 + timedelta(minutes=1), metrics=ALL).collect()] == ["R001"]
    assert [x.robot_id for x in router.route_query(t, T0, T0 + timedelta(hours=1), metrics=ALL).collect()] == ["R001", "R999"]


def test_metric_choice_ignores_case_and_pressure_is_averaged_only(spark, readings):
    t = tables(spark, readings({"event_time": T0, "pressure": 1000.0}))
    out = router.route_query(t, T0, T0 + timedelta(minutes=1), metrics=["PRESSURE", "noise"])
    assert out.columns == ["robot_id", "robot_name", "robot_type", "avg_pressure", "data_count"]


def test_filters(spark, readings):
    r = readings(*[{"event_time": T0, "robot_id": x, "sensor_type": s} for x in ("R001", "R002") for s in ("TEMPERATURE", "NOISE")])
    t = tables(spark, r, ("R001", "R002"))
    end = T0 + timedelta(hours=1)
    assert router.route_query(t, T0, end, ["R002"], None, ALL).collect()[0].data_count == 2
    assert router.route_query(t, T0, end, ["R002"], ["NOISE"], ALL).collect()[0].data_count == 1
    assert router.route_query(t, T0, end, [], [], ALL).count() == 2
    many = [f"R{i:05d}" for i in range(3000)] + ["R001"]
    assert [x.robot_id for x in router.route_query(t, T0, end, many, None, ALL).collect()] == ["R001"]


@pytest.mark.parametrize("args", [
    dict(start="2024-01-01T00:00:00", end="2024-01-02 00:00:00"),
    dict(start=None, end="2024-01-02 00:00:00"),
    dict(start="2024-1-01 00:00:00", end="2024-01-02 00:00:00"),
    dict(start="2024-01-01 00:00:00", end="2024-01-02 00:00:00", metrics=["data_count"]),
    dict(start="2024-01-01 00:00:00", end="2024-01-02 00:00:00", robot_ids=["r1; DROP"]),
    dict(start="2024-01-01 00:00:00", end="2024-01-02 00:00:00", sensor_types=["TEMP1"])])
def test_bad_arguments(args):
    with pytest.raises(ValueError):
        router.check_arguments(**args)


def test_rollup_mean_is_exact_with_gaps(spark, readings):
    r = readings({"event_time": T0, "temperature": 10.0}, {"event_time": T0, "temperature": None},
                 {"event_time": T0 + timedelta(hours=1), "temperature": 40.0})
    row = router.route_query(tables(spark, r), T0, T0 + timedelta(days=2), metrics=["temperature"]).first()
    assert (row.avg_temperature, row.max_temperature, row.data_count) == (25.0, 40.0, 3)


def test_rollup_equals_facts_on_whole_days(spark, sf):
    r = star.readings(spark, sf)
    t = router.Tables(r, r, star.dim_robot(spark, sf), build_hourly(r))
    low, high = datetime(2024, 1, 3), datetime(2024, 1, 20)
    rollup = router.route_query(t, low, high, metrics=["temperature", "humidity"])
    facts = router.incremental(r, low, high + timedelta(days=1) - timedelta(microseconds=1), ["temperature", "humidity"])

    def shaped(df):
        return {(x.robot_id, round(x.avg_temperature or 0, 6), x.max_humidity, x.data_count) for x in df.collect()}

    assert shaped(rollup) == shaped(facts)


def test_hourly_counts(readings):
    r = readings({"status": "NORMAL"}, {"status": "ABNORMAL"}, {"status": None})
    row = build_hourly(r).first()
    assert (row.dt, row.hr, row.data_count, row.abnormal_count, row.avg_temperature) == ("2024-01-01", "00", 3, 2, None)


def test_partitioned_table_is_pruned(spark, readings, folder):
    from plantpulse.sinks.tables import append_readings
    append_readings(readings(*[{"event_time": T0 + timedelta(days=i)} for i in range(4)]), folder)
    out = router.incremental(spark.read.parquet(folder), T0, T0 + timedelta(days=1), ALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [" in plan
    assert out.first().data_count == 2


def test_dimension_joins_after_aggregation(spark, sf):
    out = router.realtime(star.readings(spark, sf), star.dim_robot(spark, sf), datetime(2024, 1, 1), datetime(2024, 1, 31))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
