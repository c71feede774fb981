"""Alert rules: a metric beyond a threshold for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantpulse.functions.metrics import long_form
from plantpulse.functions.timefn import seconds_between
from plantpulse.operators.ordered import CHUNK, islands, with_chunk
from plantpulse.schemas import ALERT_CONDITION, METRICS
from plantpulse.session import small


def parsed_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules with their condition as columns."""
    return (
        rules.filter(F.col("enable_flag") == 1)
        .withColumn("c", F.from_json("conditions", ALERT_CONDITION))
        .select("rule_id", "severity", F.col("rule_type").alias("alert_type"),
                "c.metric", "c.operator", "c.threshold", "c.duration"))


def judged(readings: DataFrame, rules: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """One row per rule and reading that carries the rule's metric, with `breach` set. `metrics` names the columns that
    rules are judged on, such as the battery level of a status history.

    Rules join on the metric name, by broadcast while they are few. Beyond that it is a shuffled join,
    whose few large metric partitions adaptive execution splits.
    """
    kept = [*keys, "event_time", "data_id", *[c for c in (CHUNK,) if c in readings.columns]]
    values = long_form(readings, kept, metrics).filter(~F.isnan("value"))
    joined = values.join(small(rules.select("rule_id", "metric", "operator", "threshold")), "metric")
    v, limit, op = F.col("value"), F.col("threshold"), F.col("operator")
    breach = (
        F.when(op == ">", v > limit).when(op == "<", v < limit)
        .when(op == ">=", v >= limit).when(op == "<=", v <= limit)
        .when(op == "=", v == limit).otherwise(F.lit(False)))
    return joined.select("rule_id", *kept, breach.alias("breach"))


def breach_runs(readings: DataFrame, rules: DataFrame, keys: list[str], chunk_seconds: int = 3600,
                busy_rows: int | None = None, metrics=METRICS) -> DataFrame:
    """Every unbroken run of breaching readings per rule and key.

    Readings are shuffled once, before they fan out into one row per rule: all later steps group by the
    key and its chunk, so the rules' rows stay where their reading is.
    """
    slim = readings.select(*keys, "event_time", "data_id", *metrics)
    placed = with_chunk(slim, keys, "event_time", chunk_seconds, busy_rows).repartition(*keys, CHUNK)
    rows = judged(placed, parsed_rules(rules), keys, metrics)
    return islands(rows, [*keys, "rule_id"], "event_time", "data_id", "breach")


def sustained_alerts(readings: DataFrame, rules: DataFrame, keys=("robot_id", "sensor_id"),
                     chunk_seconds: int = 3600, busy_rows: int | None = None, metrics=METRICS) -> DataFrame:
    """One alert per run that lasts at least the rule's duration, from first to last breaching reading."""
    keys = list(keys)
    runs = breach_runs(readings, rules, keys, chunk_seconds, busy_rows, metrics)
    details = parsed_rules(rules).select("rule_id", "alert_type", "severity", "duration")
    lasted = seconds_between("start_time", "end_time")
    return (
        runs.join(small(details), "rule_id").filter(lasted >= F.col("duration"))
        .select("rule_id", "alert_type", "severity", *keys, "start_time", "end_time", "readings",
                lasted.alias("lasted_seconds")))


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alerts in the layout of the alert table; the id is derived, so a rerun yields the same rows."""
    sensor = F.col("sensor_id") if "sensor_id" in alerts.columns else F.lit(None).cast("string")
    return alerts.select(
        F.md5(F.concat_ws("|", "rule_id", "robot_id", F.coalesce(sensor, F.lit("")),
                          F.col("start_time").cast("string"))).alias("alert_id"),
        "rule_id", "alert_type", "severity",
        F.concat(F.col("rule_id"), F.lit(" on "), F.col("robot_id")).alias("title"),
        F.concat(F.lit("held for "), F.col("lasted_seconds").cast("string"), F.lit(" s")).alias("content"),
        "robot_id", sensor.alias("sensor_id"), F.lit("ACTIVE").alias("status"),
        F.col("end_time").alias("create_time"))
