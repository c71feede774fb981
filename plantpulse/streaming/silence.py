"""Status events from heartbeats: ONLINE when a robot reports, OFFLINE when it falls silent.

Keyed state with event-time timers: per robot the last heartbeat and those that came but are not yet final. A
heartbeat counts once the watermark has passed it, so heartbeats may come in any order within the delay and the
events do not depend on how they were cut into batches. A timer fires for a robot from which nothing comes any
more; the state of a robot that is OFFLINE is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "robot_id string, status string, event_time timestamp_ntz"
STATE = "last bigint, pending array<bigint>"


def walk(last: int | None, times: list[int], until: int, timeout: int) -> tuple[list[tuple[str, int]], int | None]:
    """Events of final heartbeats (ascending) after `last`, None being silence, up to `until`; and the new `last`."""
    events = []
    for t in times:
        if last is not None and t - last > timeout:
            events.append(("OFFLINE", last + timeout))
            last = None
        if last is None:
            events.append(("ONLINE", t))
        last = t if last is None else max(last, t)
    if last is not None and last + timeout <= until:
        events.append(("OFFLINE", last + timeout))
        last = None
    return events, last


def _judge(timeout: int):
    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending = state.get if state.exists else (None, [])
        pending = list(pending)
        for batch in batches:
            pending.extend(batch["event_time"].astype("datetime64[us]").astype("int64").tolist())
        until = state.getCurrentWatermarkMs() * 1000
        events, last = walk(last, sorted(t for t in pending if t <= until), until, timeout)
        pending = [t for t in pending if t > until]
        if last is None and not pending:
            state.remove()
        else:
            state.update((last, pending))
            due = min([*pending, *([last + timeout] if last is not None else [])])
            state.setTimeoutTimestamp(max(due, until) // 1000 + 1)
        if events:
            status, at = zip(*events)
            yield pd.DataFrame({"robot_id": key[0], "status": status, "event_time": pd.Series(at, dtype="int64").astype("datetime64[us]")})

    return judge


def status_events(heartbeats: DataFrame, timeout_seconds: int = 30, delay: str = "10 minutes") -> DataFrame:
    """(robot_id, status, event_time) of a stream of heartbeats; a silence longer than the timeout is OFFLINE.

    Heartbeats later than the delay are left out, as are those without a robot or a time. A robot with very many
    heartbeats holds those of the delay in its state, no more.
    """
    rows = heartbeats.filter("robot_id IS NOT NULL AND event_time IS NOT NULL").select(
        "robot_id", F.col("event_time").cast("timestamp").alias("event_time")).withWatermark("event_time", delay)
    return rows.groupBy("robot_id").applyInPandasWithState(
        _judge(timeout_seconds * 1_000_000), EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
