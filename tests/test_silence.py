"""Status events from heartbeats: gaps, order within the delay, restart."""

import random
from datetime import datetime, timedelta

from plantpulse.streaming import silence

T0 = datetime(2024, 1, 1)


def expected(times, until, timeout):
    events, times = [], sorted(t for t in times if t <= until)
    for i, t in enumerate(times):
        if i == 0 or t - times[i - 1] > timeout:
            events.append(("ONLINE", t))
        after = times[i + 1] if i + 1 < len(times) else None
        if after - t > timeout if after is not None else t + timeout <= until:
            events.append(("OFFLINE", t + timeout))
    return events


def test_walk_is_the_same_however_it_is_cut():
    r = random.Random(4)
    for _ in range(200):
        times = sorted(r.randrange(300) for _ in range(r.randrange(1, 20)))
        want = expected(times, 300, 15)
        cuts = sorted(r.randrange(300) for _ in range(3)) + [300]
        last, got, low = None, [], -1
        for until in cuts:
            events, last = silence.walk(last, [t for t in times if low < t <= until], until, 15)
            got, low = got + events, max(low, until)
        assert sorted(got, key=lambda e: (e[1], e[0])) == sorted(want, key=lambda e: (e[1], e[0]))


def test_events_over_a_restart_and_out_of_order(spark, folder):
    schema = "robot_id string, event_time timestamp_ntz"
    beats = [("R1", T0 + timedelta(seconds=s)) for s in (0, 20, 10, 200, 210)] + [("R2", T0 + timedelta(seconds=5)), (None, T0), ("R3", None)]
    later = [("R1", T0 + timedelta(seconds=205)), ("R2", T0 + timedelta(seconds=1000)), ("R9", T0 + timedelta(seconds=1500))]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        events = silence.status_events(spark.readStream.schema(schema).parquet(f"{folder}/in"), 30, "1 minute")
        query = (events.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/marks")
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    run(beats)
    run(later)
    got = {(r.robot_id, r.status, int((r.event_time - T0).total_seconds())) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {("R1", "ONLINE", 0), ("R1", "OFFLINE", 50), ("R1", "ONLINE", 200), ("R1", "OFFLINE", 240),
                   ("R2", "ONLINE", 5), ("R2", "OFFLINE", 35), ("R2", "ONLINE", 1000), ("R2", "OFFLINE", 1030)}
