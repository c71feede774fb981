from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from plantpulse.operators import ordered, positions, raw
from plantpulse.sources import star, tables

T0 = datetime(2024, 1, 5, 10)


@pytest.fixture
def ten(readings):
    return readings(*[{"event_time": T0 + timedelta(minutes=i), "robot_id": f"R{i % 3:03d}"} for i in range(10)])


def ids(df):
    return [r.data_id for r in df.collect()]


def test_systematic(ten):
    assert sorted(ids(raw.sample_systematic(ten, ["event_time", "data_id"], 4))) == ["d000", "d002", "d004", "d006"]
    assert len(ids(raw.sample_systematic(ten, ["event_time", "data_id"], 10))) == 10
    assert len(ids(raw.sample_systematic(ten, ["event_time", "data_id"], 99))) == 10
    assert sorted(ids(raw.sample_systematic(ten, ["event_time", "data_id"], 3))) == ["d000", "d003", "d006"]


@pytest.mark.parametrize("n", [3, 10, 50])
def test_random_sample_size(ten, n):
    got = ids(raw.sample_random(ten, n, seed=5))
    assert len(set(got)) == len(got) == min(n, 10)
    assert got == ids(raw.sample_random(ten, n, seed=5))


def test_sample_by_name(ten):
    order = ["event_time", "data_id"]
    assert ids(raw.sample(ten, 2, "other", order)) == ["d000", "d001"]
    assert len(ids(raw.sample(ten, 2, "random", order))) == 2
    assert sorted(ids(raw.sample(ten, 2, "systematic", order))) == ["d000", "d005"]


def test_large_samples_number_the_rows(ten, monkeypatch):
    monkeypatch.setattr(raw, "HEAP_ROWS", 1)
    order = ["event_time", "data_id"]
    assert sorted(ids(raw.sample_head(ten, order, 4))) == ["d000", "d001", "d002", "d003"]
    assert sorted(ids(raw.newest(ten, 2))) == ["d008", "d009"]
    assert len(ids(raw.sample_random(ten, 4))) == 4
    page = raw.page(ten, order, 2, 4).collect()
    assert sorted(r.data_id for r in page) == ["d004", "d005", "d006", "d007"]
    assert {(r.total, r.pages) for r in page} == {(10, 3)}


@pytest.mark.parametrize("n,size", [(3, 2), (7, 3), (10, 4)])
def test_one_answer_however_rows_are_found(readings, monkeypatch, n, size):
    """NULL order columns and repeated rows: bounded sorts and numbered rows agree, and nothing is lost."""
    r = readings(*[{"event_time": None if i % 3 == 0 else T0 + timedelta(minutes=i % 4), "data_id": None if i % 5 == 0 else f"d{i % 4}",
                    "robot_id": f"R{i % 2}"} for i in range(12)])

    def rows(df):
        return [tuple(x) for x in df.select("event_time", "data_id", "robot_id").collect()]

    found = []
    for limit in (100, 0):
        monkeypatch.setattr(raw, "HEAP_ROWS", limit)
        pages = [sorted(map(str, rows(raw.page(r, ["event_time"], p, size, descending=p % 2 == 0)))) for p in range(1, 6)]
        found.append((sorted(map(str, rows(raw.first_rows(r, ["event_time", "data_id"], n)))), pages,
                      sorted(map(str, rows(raw.sample_random(r, n, seed=2)))), sorted(map(str, rows(raw.sample_head(r, ["event_time"], n))))))
        assert len(found[-1][0]) == len(found[-1][2]) == n
        walked = [x for p in range(1, 20) for x in rows(raw.page(r, ["event_time"], p, size))]
        assert sorted(map(str, walked)) == sorted(map(str, rows(r)))
    assert found[0] == found[1]
    assert raw.sample_systematic(r, ["event_time"], 99).count() == 12


def test_busy_keys_may_be_null_and_rows_without_time(spark):
    df = spark.range(200).select(F.lit(None).cast("string").alias("k"), F.when(F.col("id") % 10 > 0, F.timestamp_seconds(F.col("id") * 60)).cast(
        "timestamp_ntz").alias("t"), F.col("id").cast("string").alias("i"), (F.col("id") % 7 > 0).alias("inside"))
    cut = ordered.with_chunk(df, ["k"], "t", 600, busy_rows=0)
    assert cut.count() == 200 and cut.select(ordered.CHUNK).distinct().count() > 10 and cut.filter(F.col(ordered.CHUNK).isNull()).count() == 0
    got = ordered.with_previous(df, ["k"], ["t", "i"], "i", "p", "t", 600, 0)
    want = df.withColumn("p", F.lag("i").over(Window.partitionBy("k").orderBy("t", "i")))
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_page_past_the_end(readings):
    five = readings(*[{"event_time": T0 + timedelta(minutes=i)} for i in range(5)])
    assert raw.page(five, ["event_time", "data_id"], 9, 2).count() == 0
    assert raw.page_summary(five, 2).first()[:] == (5, 3)
    assert raw.page_by_position(five, ["event_time", "data_id"], 9, 2).count() == 0


def test_next_page_walks_everything(ten):
    order, last, seen = ["event_time", "data_id"], None, []
    while rows := raw.next_page(ten, order, last, 3).collect():
        seen += [r.data_id for r in rows]
        last = (rows[-1].event_time, rows[-1].data_id)
    assert seen == [f"d{i:03d}" for i in range(10)]


def test_latest_keeps_ties(readings):
    r = readings({"event_time": T0}, {"event_time": T0}, {"event_time": T0 - timedelta(1)}, {"robot_id": "R002", "event_time": T0})
    assert sorted(ids(raw.latest_per_robot(r))) == ["d000", "d001", "d003"]


def test_latest_drops_rows_before_the_shuffle(ten):
    plan = raw.latest_per_robot(ten)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_newest_and_range(ten):
    assert ids(raw.newest(ten, 2)) == ["d009", "d008"]
    assert ids(raw.newest(ten, 2, ["R000"])) == ["d009", "d006"]
    assert ids(raw.newest(ten, 0)) == []
    assert ids(raw.time_range(ten, T0, T0 + timedelta(minutes=2))) == ["d002", "d001", "d000"]
    assert ids(raw.time_range(ten, T0, T0 + timedelta(minutes=9), ["R000"], ["NOISE"])) == []


def test_row_index_counts_every_partition(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    numbered, total = ordered.with_row_index(df.repartition(7), ["v"])
    assert total == 1000
    assert numbered.filter(F.col("v") != F.col("row_index")).count() == 0
    assert ordered.with_row_index(df.filter("v < 0"), ["v"])[1] == 0


def brute_islands(rows):
    out, run, key = set(), [], None
    for k, t, i, inside in sorted(rows):
        if k != key or not inside:
            if run:
                out.add((key, run[0], run[-1], len(run)))
            run, key = [], k
        if inside:
            run.append(t)
    if run:
        out.add((key, run[0], run[-1], len(run)))
    return out


@pytest.mark.parametrize("chunk,busy", [(60, 0), (3600, 0), (600, 500), (600, None), (10**9, 0)])
def test_islands_equal_brute_force_with_a_hot_key(spark, chunk, busy):
    import random
    rnd = random.Random(chunk)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b"]), T0 + timedelta(seconds=rnd.randrange(20000)), f"{i:05d}", rnd.random() < 0.6)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i string, inside boolean")
    got = {tuple(r) for r in ordered.islands(df, ["k"], "t", "i", "inside", chunk, busy).collect()}
    assert got == brute_islands(rows)


@pytest.mark.parametrize("chunk,busy", [(30, 0), (5000, 0), (30, 100), (30, None)])
def test_previous_equals_a_plain_window(spark, chunk, busy):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 5).alias("k"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 37 % 4000)).cast("timestamp_ntz").alias("t"),
        F.col("id").alias("i"), F.when(F.col("id") % 4 != 0, F.col("id").cast("string")).alias("v"))
    got = ordered.with_previous(df, ["k"], ["t", "i"], "v", "p", "t", chunk, busy)
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t", "i")))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 500


def test_no_unpartitioned_window(spark, sf):
    """Nothing sorts a whole table, or a whole key, in one task."""
    from __spark_entry__ import queries
    for name in ("alert_rules_sustained", "command_transitions", "sample_systematic", "page_deep", "generic_aggregate", "type_share"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if " Window [" in line:
                inside = line.split("], [")
                assert len(inside) >= 3 or "__chunk" in line, (name, line)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_id_lists(ten):
    assert tables.with_ids(ten, "robot_id", None).count() == 10
    assert tables.with_ids(ten, "robot_id", ["R000"], listed=0).count() == 4


def test_csv_and_listing(spark, ten, folder):
    ten.limit(4).coalesce(1).write.csv(folder + "/a/b", header=True)
    got = tables.csv_files(spark, folder)
    assert got.count() == 4 and got.schema == ten.schema
    assert tables.csv_files(spark, folder, before=datetime(2000, 1, 1)).count() == 0
    listed = tables.file_listing(spark, folder, "*.csv").collect()
    assert len(listed) == 1 and listed[0].bytes > 0


def test_robot_sensor_latest(spark, sf):
    out = raw.robot_sensor_latest(star.robot_status(spark, sf), star.dim_robot(spark, sf), star.readings(spark, sf), star.dim_sensor(spark, sf))
    assert out.count() == star.readings(spark, sf).select("robot_id").distinct().count()
    assert out.filter("location is null or sensor_name is null").count() == 0


def _placed(rows, order, descending=False):
    """Rows in the order that pages and samples use, ties apart; NULL first, or last when descending."""
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in order), reverse=descending)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("range_rows", [positions.RANGE_ROWS, 40])
def test_positions_equal_a_full_sort(spark, descending, range_rows):
    rows = [(i % 7 if i % 3 else None, float((i * 37) % 200 if i % 11 else 5), i) for i in range(900)] + [(3, 5.0, 2000)] * 60
    df = spark.createDataFrame(rows, "a int, b double, c bigint").withColumn("h", F.xxhash64("a", "b", "c"))
    asked = [(0, 3), (100, 120), (333, 333), (700, 760), (950, 2000)]
    found, total = positions.picked(df, ["a", "b", "c"], lambda n: asked, "h", descending, range_rows)
    want = _placed(rows_of := [dict(zip("abc", r)) for r in rows], "abc", descending)
    want = [want[i] for low, high in asked for i in range(low, min(high + 1, len(rows)))]
    assert total == len(rows_of)
    assert sorted(map(repr, (r.asDict() for r in found.drop("h").collect()))) == sorted(map(repr, want))


def test_positions_of_text_and_of_nothing(spark):
    df = spark.createDataFrame([(f"é{i % 50:03d}", i) for i in range(500)], "a string, b int").withColumn("h", F.xxhash64("a", "b"))
    found, total = positions.picked(df, ["a", "b"], lambda n: [(n - 2, n - 1)], "h")
    assert total == 500 and sorted(map(tuple, found.select("a", "b").collect())) == [("é049", 449), ("é049", 499)]
    assert positions.picked(df.limit(0), ["a"], lambda n: [(0, 5)], "h")[0].collect() == []


def test_a_page_sorts_only_its_range(spark):
    df = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    found, _ = positions.picked(df, ["id"], lambda n: [(9_000, 9_010)], "h")
    assert [r.id for r in found.orderBy("id").collect()] == list(range(9_000, 9_011))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "id" in plan and ">=" in plan and "<=" in plan and "RepartitionByExpression" not in plan
