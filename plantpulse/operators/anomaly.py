"""Anomalies among robot mean temperatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

_COLUMNS = ("robot_id", "anomaly_type", "metric", "value", "expected_min", "expected_max", "severity")

# Bounds of the threshold method.
TEMPERATURE_MIN, TEMPERATURE_MAX, CRITICAL_ABOVE = 0.0, 100.0, 80.0


def _shaped(rows: DataFrame, kind: str, low, high, severity) -> DataFrame:
    return rows.select(
        "robot_id", F.lit(kind).alias("anomaly_type"), F.lit("temperature").alias("metric"),
        F.col("avg_temperature").alias("value"), low.alias("expected_min"),
        high.alias("expected_max"), severity.alias("severity"))


def statistical(routed: DataFrame) -> DataFrame:
    """Further than three population deviations from the mean of all robots."""
    means = routed.select("robot_id", "avg_temperature").filter(F.col("avg_temperature").isNotNull())
    overall = means.agg(F.struct(
        F.avg("avg_temperature").alias("mean"), F.stddev_pop("avg_temperature").alias("sigma")).alias("s"))
    with_overall = means.withColumn("s", overall.scalar())
    mean, reach = F.col("s.mean"), F.col("s.sigma") * 3
    far = F.abs(F.col("avg_temperature") - mean) > reach
    return _shaped(with_overall.filter(far & ~F.isnan("avg_temperature")), "STATISTICAL",
                   mean - reach, mean + reach, F.lit("HIGH"))


def threshold(routed: DataFrame) -> DataFrame:
    """Mean temperature outside the fixed bounds."""
    t = F.col("avg_temperature")
    out = routed.filter(~F.isnan(t) & ((t < TEMPERATURE_MIN) | (t > TEMPERATURE_MAX)))
    severity = F.when(t > CRITICAL_ABOVE, "CRITICAL").otherwise("MEDIUM")
    return _shaped(out, "THRESHOLD", F.lit(TEMPERATURE_MIN), F.lit(TEMPERATURE_MAX), severity)


_METHODS = {"statistical": statistical, "threshold": threshold}


def detect(routed: DataFrame, algorithms) -> DataFrame:
    """Results of the named methods one after the other; a robot may appear once per method."""
    found = [method(routed) for name, method in _METHODS.items() if name in algorithms]
    if not found:
        return threshold(routed).filter(F.lit(False))
    return reduce(DataFrame.unionByName, found)
