"""Robots, their state and their command log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.functions import health
from plantpulse.functions.columns import as_col
from plantpulse.functions.timefn import at, seconds_between
from plantpulse.operators.ordered import with_previous
from plantpulse.schemas import DATA_TAGS
from plantpulse.sources.messages import as_json
from plantpulse.sources.tables import with_ids

# Status changes the command life cycle allows ("" = no earlier status).
LEGAL_CHANGES = [
    ("", "PENDING"), ("", "FAILED"),
    ("PENDING", "EXECUTED"), ("PENDING", "FAILED"), ("PENDING", "CANCELLED"),
    ("FAILED", "RETRYING"),
    ("RETRYING", "PENDING"), ("RETRYING", "EXECUTED"), ("RETRYING", "FAILED"),
]
TASK_STATUS_AFTER = {
    "START_TASK": "RUNNING", "RESUME_TASK": "RUNNING", "STOP_TASK": "STOPPED", "PAUSE_TASK": "PAUSED",
}


def active_robots(robots: DataFrame, robot_ids=None) -> DataFrame:
    return with_ids(robots, "robot_id", robot_ids).filter(F.col("status") == 1)


def status_by_ids(status: DataFrame, robot_ids=None, ids: DataFrame | None = None) -> DataFrame:
    """State rows of the named robots; `ids` may be a table of robot_id."""
    if ids is not None:
        return status.join(ids.select("robot_id").distinct(), "robot_id", "left_semi")
    return with_ids(status, "robot_id", robot_ids)


def command_by_id(commands: DataFrame, command_id: str) -> DataFrame:
    return commands.filter(F.col("command_id") == command_id)


def online_robots(status: DataFrame) -> DataFrame:
    return status.filter(F.col("status") == "ONLINE").select("robot_id")


def status_counts(df: DataFrame) -> DataFrame:
    """Rows per status."""
    return df.groupBy("status").agg(F.count("*").alias("n"))


def system_totals(status: DataFrame, commands: DataFrame) -> DataFrame:
    """Totals of robots, online robots and commands, one row each."""
    robots = status.agg(F.count("*").alias("total_robots"),
                        F.count_if(F.col("status") == "ONLINE").alias("online_robots"))
    names = {"total_robots": "total_robots", "online_robots": "online_robots"}
    rows = robots.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("name"), F.col(v).alias("n")) for k, v in names.items()])))
    return rows.unionByName(commands.agg(F.count("*").alias("n")).select(F.lit("total_commands").alias("name"), "n"))


def command_history(commands: DataFrame, limit: int = 10, robot_id: str | None = None) -> DataFrame:
    """Newest commands per robot. Map tasks already drop what is beyond the limit."""
    if robot_id is not None:
        return (commands.filter(F.col("robot_id") == robot_id)
                .orderBy(F.desc("create_time"), F.desc("command_id")).limit(limit))
    w = Window.partitionBy("robot_id").orderBy(F.desc("create_time"), F.desc("command_id"))
    return commands.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def command_latest(events: DataFrame) -> DataFrame:
    """Last status of each command in the log."""
    return events.groupBy("command_id").agg(
        F.max_by("status", F.struct("event_time", "event_seq", "status")).alias("status"),
        F.max("event_time").alias("event_time"), F.count("*").alias("changes"))


def command_transitions(events: DataFrame, chunk_seconds: int = 30 * 86400, busy_rows: int | None = None) -> DataFrame:
    """Each status change with the one before it and whether the life cycle allows it."""
    linked = with_previous(events, ["command_id"], ["event_time", "event_seq", "status"], "status",
                           "previous_status", "event_time", chunk_seconds, busy_rows)
    change = F.concat_ws(">", F.coalesce("previous_status", F.lit("")), "status")
    return linked.withColumn("legal", change.isin([f"{a}>{b}" for a, b in LEGAL_CHANGES]))


def retry_eligible(commands: DataFrame) -> DataFrame:
    """Commands with whether another attempt is allowed: failed, and retries left."""
    return commands.withColumn(
        "can_retry", (F.col("status") == "FAILED") & (F.col("retry_count") < F.col("max_retry")))


def cancellable(commands: DataFrame) -> DataFrame:
    return commands.filter(F.col("status") == "PENDING")


def task_status_after(command_type="command_type") -> F.Column:
    """Task status a command leads to, NULL when it changes none."""
    kind = as_col(command_type)
    out = F.lit(None).cast("string")
    for name, status in TASK_STATUS_AFTER.items():
        out = F.when(kind == name, status).otherwise(out)
    return out


def task_status(commands: DataFrame, status: DataFrame) -> DataFrame:
    """Task status per robot after its last executed task command, else the one it had."""
    moved = (
        commands.filter(F.col("status") == "EXECUTED")
        .withColumn("after", task_status_after()).filter(F.col("after").isNotNull())
        .groupBy("robot_id")
        .agg(F.max_by("after", F.struct("execute_time", "command_id")).alias("after")))
    return status.join(moved, "robot_id", "left").select(
        "robot_id", F.coalesce("after", "task_status").alias("task_status"))


def command_durations(commands: DataFrame) -> DataFrame:
    """Seconds between start and completion of completed commands."""
    return commands.filter(F.col("complete_time").isNotNull()).select(
        "command_id", seconds_between("execute_time", "complete_time").alias("duration_seconds"))


def latest_status(heartbeats: DataFrame, now: datetime, timeout_seconds: int = 30, robots: DataFrame | None = None) -> DataFrame:
    """Last heartbeat per robot; older than the timeout means OFFLINE. With a robot table its robots without any
    heartbeat are OFFLINE too."""
    last = heartbeats.groupBy("robot_id").agg(
        F.max_by("status", F.struct("event_time", "data_id")).alias("reported_status"),
        F.max("event_time").alias("last_update_time"))
    if robots is not None:
        last = last.join(robots.select("robot_id").distinct(), "robot_id", "full")
    return with_freshness(last, now, timeout_seconds)


def with_freshness(latest: DataFrame, now: datetime, timeout_seconds: int = 30) -> DataFrame:
    limit = F.col("last_update_time") + F.expr(f"INTERVAL '{int(timeout_seconds)}' SECOND")
    fresh = limit >= at(now)
    return latest.withColumn("status", F.when(fresh, F.col("reported_status")).otherwise("OFFLINE"))


def abnormal_robots(status: DataFrame) -> DataFrame:
    """State rows with abnormal flag, severity and description."""
    return status.withColumns({
        "abnormal": health.is_abnormal(), "severity": health.severity(), "description": health.description()})


def robot_alerts(status: DataFrame) -> DataFrame:
    """Alert rows for abnormal robots; works on batch and streaming input."""
    return abnormal_robots(status).filter("abnormal").select(
        "robot_id", "robot_name", F.lit("ROBOT_ABNORMAL").alias("alert_type"), "severity",
        "description", "status", "task_status")


def topic_messages(rows: DataFrame, kind: str, all_topic: str) -> DataFrame:
    """Each row twice: on the robot's own topic and on the one for all robots."""
    own = F.concat(F.lit("/topic/robots/"), F.col("robot_id"), F.lit(f"/{kind}"))
    return rows.select(
        F.explode(F.array(own, F.lit(all_topic))).alias("topic"), F.col("robot_id").alias("key"),
        as_json(*rows.columns).alias("value"))


def status_messages(status: DataFrame) -> DataFrame:
    return topic_messages(status, "status", "/topic/robots/all/status")


def alert_messages(alerts: DataFrame) -> DataFrame:
    return topic_messages(alerts, "alerts", "/topic/alerts")


def command_messages(commands: DataFrame) -> DataFrame:
    """Command updates go to the robot's own topic only."""
    return commands.select(
        F.concat(F.lit("/topic/robots/"), F.col("robot_id"), F.lit("/commands")).alias("topic"),
        F.col("robot_id").alias("key"), as_json(*commands.columns).alias("value"))


def upsert_robots(robots: DataFrame, updates: DataFrame) -> DataFrame:
    """Status, location and update time changed by id; the last update per robot wins.

    Updates are reduced to one row per robot before the join. Unknown ids change nothing.
    """
    fields = ("status", "location", "update_time")
    last = updates.groupBy("robot_id").agg(
        F.max_by(F.struct(*fields), F.struct("update_time", "location", "status")).alias("u"))
    joined = robots.join(last, "robot_id", "left")
    return joined.select(*[
        F.coalesce(F.col("u")[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in robots.columns])


def tag_text(tags: F.Column) -> F.Column:
    """A set of tags, comma separated: known ones in the fixed order, then any others by name."""
    known = F.array(*[F.lit(t) for t in DATA_TAGS])
    others = F.sort_array(F.array_except(tags, known))
    return F.concat_ws(",", F.filter(known, lambda t: F.array_contains(tags, t)), others)


def tags_per_reading(tags: DataFrame) -> DataFrame:
    """data_id and the set of its tags as text. A reading that is tagged over and over costs no more than one."""
    return tags.groupBy("data_id").agg(tag_text(F.array_compact(F.collect_set("tag"))).alias("tags"))


def tagged(readings: DataFrame, tags: DataFrame) -> DataFrame:
    return readings.join(tags_per_reading(tags), "data_id", "left")


def own_tags() -> F.Column:
    """Tags a reading earns by itself: raw always, anomaly when not normal, critical when very hot."""
    return F.array_compact(F.array(
        F.lit("raw"),
        F.when(F.col("status") != "NORMAL", "anomaly"),
        F.when(F.col("temperature") > 100, "critical")))


def derived_tags(readings: DataFrame) -> DataFrame:
    """The earned tags, one row each."""
    return readings.select("data_id", F.explode(own_tags()).alias("tag"))


def reading_tags(readings: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """data_id and all its tags: earned ones from the row itself, and those of the table `attached` (data_id, tag).

    Only the attached tags are grouped; without any the readings are not shuffled.
    """
    if attached is None:
        return readings.select("data_id", tag_text(own_tags()).alias("tags"))
    given = attached.groupBy("data_id").agg(F.collect_set("tag").alias("__tags"))
    none = F.array().cast("array<string>")
    return readings.join(given, "data_id", "left").select(
        "data_id", tag_text(F.array_union(own_tags(), F.coalesce("__tags", none))).alias("tags"))


# Buckets of the subscriptions that name neither robots nor types.
CATCH_ALL_BUCKETS = 8


def subscription_matches(readings: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscription_id, data_id) for every reading a subscription covers.

    A missing or empty list means all. Subscriptions that name robots join on the robot, those that name only
    types on the type. Those that name nothing are dealt to a fixed number of buckets, and each reading meets every
    bucket by equality: they stay a table of any length, and Spark splits the rows they make.
    """
    def given(c):
        return F.coalesce(F.size(c) > 0, F.lit(False))

    rows = readings.select("data_id", "robot_id", "sensor_type")
    by_robot = subscriptions.filter(given("robot_ids")).select(
        "subscription_id", F.explode(F.array_distinct("robot_ids")).alias("robot_id"), "sensor_types")
    covered = ~given("sensor_types") | F.array_contains("sensor_types", F.col("sensor_type"))
    named = rows.join(by_robot, "robot_id").filter(covered)

    unnamed = subscriptions.filter(~given("robot_ids"))
    by_type = unnamed.filter(given("sensor_types")).select(
        "subscription_id", F.explode(F.array_distinct("sensor_types")).alias("sensor_type"))
    wide = rows.join(by_type, "sensor_type")
    everything = unnamed.filter(~given("sensor_types")).select(
        "subscription_id", F.pmod(F.xxhash64("subscription_id"), F.lit(CATCH_ALL_BUCKETS)).cast("int").alias("bucket"))
    buckets = F.explode(F.sequence(F.lit(0), F.lit(CATCH_ALL_BUCKETS - 1))).alias("bucket")
    catch_all = rows.select("data_id", buckets).join(everything, "bucket")
    out = named.select("subscription_id", "data_id")
    for part in (wide, catch_all):
        out = out.unionByName(part.select("subscription_id", "data_id"))
    return out
