from datetime import datetime, timedelta
from math import inf, nan, sqrt

import pytest

from plantpulse.operators import analytics, anomaly, buckets
from plantpulse.plans import jobs

T0 = datetime(2024, 1, 5, 10)
SCHEMA = "robot_id string, avg_temperature double, avg_humidity double, avg_pressure double, data_count long"


@pytest.fixture
def routed(spark):
    def make(*temps, humidity=1.0, pressure=1.0):
        return spark.createDataFrame([(f"R{i:03d}", t, humidity, pressure, 1) for i, t in enumerate(temps)], SCHEMA)
    return make


def test_negative_maximum(routed):
    row = analytics.statistics(routed(-5.0, -2.0)).first()
    assert (row.temperature_max, row.temperature_min, row.total_records) == (-2.0, -5.0, 2)


def test_statistics_without_rows(routed, spark):
    row = analytics.statistics(spark.createDataFrame([], SCHEMA)).first()
    assert (row.total_records, row.temperature_avg, row.temperature_max, row.temperature_count) == (0, 0.0, 0.0, 0)


def test_mean_of_means(readings):
    from plantpulse.plans.router import incremental
    r = readings(*[{"event_time": T0, "temperature": 0.0}] * 3, {"event_time": T0, "robot_id": "R002", "temperature": 10.0})
    assert analytics.statistics(incremental(r, T0, T0)).first().temperature_avg == 5.0


def test_missing_counts_as_zero_in_trend_only(readings):
    from plantpulse.plans.router import incremental
    r = readings({"event_time": T0, "temperature": 10.0}, {"event_time": T0, "robot_id": "R002"})
    assert buckets.trend(r, T0, T0, "hour").first().temperature == 5.0
    assert analytics.statistics(incremental(r, T0, T0)).first().temperature_avg == 10.0


def test_trend_reads_a_wider_range(readings):
    r = readings(*[{"event_time": T0 + timedelta(hours=h), "temperature": 1.0} for h in (-11, -10, 0, 1, 2)])
    labels = {x.time_label for x in buckets.trend(r, T0, T0, "hour").collect()}
    assert labels == {"2024-01-05 00:00", "2024-01-05 10:00", "2024-01-05 11:00"}


def test_histogram_maximum(routed):
    d = routed(0.0, 5.0, 10.0)
    counts = lambda **k: [x.bucket_count for x in analytics.distribution(d, "temperature", 2, **k).orderBy("bin").collect()]
    assert counts() == [1, 1]
    assert counts(include_max=True) == [1, 2]


def test_histogram_flat_empty_and_shares(routed, spark):
    assert [x.bucket_count for x in analytics.distribution(routed(3.0, 3.0), "temperature", 3).collect()] == [0, 0, 0]
    assert analytics.distribution(spark.createDataFrame([], SCHEMA), "temperature", 3).count() == 0
    rows = analytics.distribution(routed(0.0, 1.0, 2.0, 4.0), "Temperature", 4).orderBy("bin").collect()
    assert [x.percentage for x in rows] == [25.0, 25.0, 25.0, 0.0]
    assert rows[0].std_dev == pytest.approx(sqrt(35 / 16))


def test_histogram_matches_edge_comparison(routed):
    values = [i * 0.1 for i in range(50)]
    low, step = min(values), (max(values) - min(values)) / 7
    want = [sum(low + i * step <= v < low + (i + 1) * step for v in values) for i in range(7)]
    got = [x.bucket_count for x in analytics.distribution(routed(*values), "temperature", 7).orderBy("bin").collect()]
    assert got == want


def test_quality(spark):
    d = spark.createDataFrame([
        ("a", 20.0, 1.0, 1.0, 1), ("b", None, 1.0, 1.0, 1), ("c", nan, 1.0, 1.0, 1),
        ("d", 101.0, 1.0, inf, 1), ("e", -51.0, 1.0, 1.0, 1)], SCHEMA)
    q = analytics.quality(d).first()
    assert (q.total_records, q.complete_records, q.valid_records, q.abnormal_records) == (5, 4, 3, 2)
    assert q.overall_quality == pytest.approx((0.8 + 0.6) / 2 * 100)
    empty = analytics.quality(spark.createDataFrame([], SCHEMA)).first()
    assert (empty.total_records, empty.overall_quality, empty.validity_rate) == (0, 0.0, 0.0)


def test_sigma(routed):
    found = anomaly.statistical(routed(*[10.0] * 20, 100.0)).collect()
    assert [x.value for x in found] == [100.0] and found[0].severity == "HIGH"
    assert anomaly.statistical(routed(5.0, 5.0)).count() == 0


def test_threshold(routed):
    found = {x.value: x.severity for x in anomaly.threshold(routed(-1.0, 0.0, 100.0, 101.0, nan, None)).collect()}
    assert found == {-1.0: "MEDIUM", 101.0: "CRITICAL"}


def test_detect_keeps_duplicates(routed):
    d = routed(*[10.0] * 20, 200.0)
    assert anomaly.detect(d, ["statistical", "threshold"]).count() == 2
    assert anomaly.detect(d, ["isolation_forest"]).count() == 0


def test_generic_aggregate(readings):
    r = readings(*[{"event_time": T0 + timedelta(days=i), "temperature": float(v)} for i, v in ((0, 2), (1, 4), (40, 9))])
    rows = {x.time_bucket: x for x in buckets.aggregate(r, "temperature", interval="month").collect()}
    assert rows["2024-01"].avg_value == 3.0 and rows["2024-01"].stddev_value == 1.0 and rows["2024-02"].sum_value == 9.0
    with pytest.raises(ValueError):
        buckets.aggregate(r, "temperature", ["median"])
    with pytest.raises(ValueError):
        buckets.aggregate(r, "temperature", interval="year")


def test_reports(routed):
    d = routed(1.0, None)
    assert set(analytics.report(d, "summary")) == {"statistics"}
    assert set(analytics.report(d, "detailed")) == {"data", "summary"}
    assert [x.temperature for x in analytics.report(d, "chart")["chart"].collect()] == [1.0, 0.0]
    assert analytics.report(d, "other") == {}


def test_overview_scans_once(spark, sf):
    from plantpulse.sources import star
    out = analytics.overview(star.readings(spark, sf), datetime(2024, 1, 1), datetime(2024, 1, 31))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_weekly_and_daily(readings):
    day = datetime(2024, 1, 8)
    r = readings(*[{"event_time": day + timedelta(hours=h), "temperature": 1.0} for h in (-1, 0, 23, 24)])
    assert sum(x.data_count for x in jobs.daily_summary(r, day.date()).collect()) == 2
    row = jobs.weekly_report(r, datetime(2024, 1, 15).date()).first()
    assert (row.week, row.data_count, row.period) == ("2024-02", 3, "2024-01-08 - 2024-01-14")


def test_daily_job_can_be_rerun(spark, readings, folder):
    r = readings(*[{"event_time": datetime(2024, 1, 8) + timedelta(days=i)} for i in range(2)])
    for day in (8, 9, 8):
        jobs.run_daily(r, datetime(2024, 1, day).date(), folder + "/daily")
        jobs.run_hourly_rollup(r, datetime(2024, 1, day).date(), folder + "/hourly")
    assert spark.read.parquet(folder + "/daily").count() == 2
    assert spark.read.parquet(folder + "/hourly").count() == 2
    jobs.run_daily(r.filter("event_time < '2024-01-09'"), datetime(2024, 1, 9).date(), folder + "/daily")  # nothing left of the day
    assert spark.read.parquet(folder + "/daily").count() == 1
