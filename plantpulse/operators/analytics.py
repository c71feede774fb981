"""Statistics over routed rows (one row per robot)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.functions.columns import finite, share
from plantpulse.operators.buckets import robot_cells, trend_of_cells
from plantpulse.schemas import METRICS
from plantpulse.sources.tables import in_time_range, with_ids


def statistics(routed: DataFrame) -> DataFrame:
    """One row: number of robots, and per metric mean, maximum, minimum and count of robot means.

    Every robot weighs the same, however many readings it has; without values all are 0.
    """
    return routed.agg(F.count("*").alias("total_records"), *_robot_mean_columns())


def _robot_mean_columns() -> list[Column]:
    columns = []
    for m in METRICS:
        mean = f"avg_{m}"
        columns += [
            F.coalesce(F.avg(mean), F.lit(0.0)).alias(f"{m}_avg"),
            F.coalesce(F.max(mean), F.lit(0.0)).alias(f"{m}_max"),
            F.coalesce(F.min(mean), F.lit(0.0)).alias(f"{m}_min"),
            F.count(mean).alias(f"{m}_count"),
        ]
    return columns


def overview(readings: DataFrame, start: datetime, end: datetime, robot_ids=None) -> DataFrame:
    """Summary and hourly trend as (section, label, name, value) rows.

    Both halves start from the same sums per robot and hour.
    """
    rows = with_ids(in_time_range(readings, start, end), "robot_id", robot_ids)
    cells = robot_cells(rows, "hour")
    per_robot = cells.groupBy("robot_id").agg(
        *[F.try_divide(F.sum(f"sum_{m}"), F.sum(f"cnt_{m}")).alias(f"avg_{m}") for m in METRICS],
        F.sum("data_count").alias("data_count"))
    figures = per_robot.agg(
        F.count("*").alias("robots"), F.coalesce(F.sum("data_count"), F.lit(0)).alias("records"),
        *_robot_mean_columns())
    trend = trend_of_cells(cells, "hour")
    return _as_rows(figures, "summary", F.lit("all")).unionByName(
        _as_rows(trend, "trend", F.col("time_label")))


def _as_rows(df: DataFrame, section: str, label) -> DataFrame:
    names = [c for c in df.columns if c != "time_label"]
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(F.lit(section).alias("section"), label.alias("label"), F.inline(entries))


def quality(routed: DataFrame) -> DataFrame:
    """One row of completeness, validity and abnormality counts and rates.

    Complete: every metric present. Valid: no present metric is NaN or infinite. Abnormal: mean
    temperature above 100 or below -50; NaN compares as neither.
    """
    means = [F.col(f"avg_{m}") for m in METRICS]
    complete = means[0].isNotNull() & means[1].isNotNull() & means[2].isNotNull()
    valid = (means[0].isNull() | finite(means[0])) & (means[1].isNull() | finite(means[1])) & (
        means[2].isNull() | finite(means[2]))
    t = means[0]
    abnormal = F.coalesce(~F.isnan(t) & ((t > 100) | (t < -50)), F.lit(False))
    counted = routed.agg(
        F.count("*").alias("total_records"),
        F.count_if(complete).alias("complete_records"),
        F.count_if(valid).alias("valid_records"),
        F.count_if(abnormal).alias("abnormal_records"))
    rated = counted.withColumns({
        "completeness_rate": share("complete_records", "total_records"),
        "validity_rate": share("valid_records", "total_records"),
        "abnormality_rate": share("abnormal_records", "total_records"),
    })
    return rated.withColumn(
        "overall_quality", (F.col("completeness_rate") + F.col("validity_rate")) / 2 * 100)


def distribution(routed: DataFrame, metric: str, bins: int = 10, include_max: bool = False) -> DataFrame:
    """Histogram of robot means in equal bins, with overall minimum, maximum, mean and deviation.

    Bins are half-open, so the largest value belongs to none unless `include_max`; when all values
    are equal every bin is empty. Empty bins are reported; without values there are no bins.
    """
    value = F.col(f"avg_{metric.lower()}").alias("v")
    values = routed.select(value).filter(F.col("v").isNotNull())
    facts = values.agg(F.struct(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).alias("s"))
    step = (F.col("s.high") - F.col("s.low")) / F.lit(bins)
    edge = lambda i: F.col("s.low") + i * step
    guess = F.try_divide(F.col("v") - F.col("s.low"), step)
    near = F.floor(guess)
    # the quotient may round across an edge: compare with the edges themselves
    near = near - F.when(F.col("v") < edge(near), 1).otherwise(0) + F.when(F.col("v") >= edge(near + 1), 1).otherwise(0)
    if include_max:
        near = F.when((F.col("v") == F.col("s.high")) & (step > 0), F.lit(bins - 1)).otherwise(near)
    counted = (
        values.withColumn("s", facts.scalar()).select(near.cast("bigint").alias("bin"))
        .filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n")))
    frame = routed.sparkSession.range(bins).withColumnRenamed("id", "bin").withColumn("s", facts.scalar())
    return (
        frame.filter(F.col("s.n") > 0).join(counted, "bin", "left")
        .select(
            "bin", edge(F.col("bin")).alias("bucket_min"), edge(F.col("bin") + 1).alias("bucket_max"),
            F.coalesce("n", F.lit(0)).alias("bucket_count"),
            (F.coalesce("n", F.lit(0)) / F.col("s.n") * 100).alias("percentage"),
            F.col("s.low").alias("min_value"), F.col("s.high").alias("max_value"),
            F.col("s.mean").alias("mean_value"), F.col("s.deviation").alias("std_dev")))


def chart_series(routed: DataFrame) -> DataFrame:
    """One point per robot and metric column, missing values as 0, in robot order.

    Kept as rows: packing all robots into one array would put them into one task.
    """
    return routed.select(
        F.col("robot_id").alias("label"),
        *[F.coalesce(F.col(f"avg_{m}"), F.lit(0.0)).alias(m) for m in METRICS]).orderBy("label")


def report(routed: DataFrame, kind: str) -> dict[str, DataFrame]:
    """Parts of a report: `summary`, `detailed` (rows and summary) or `chart`; others are empty."""
    if kind == "summary":
        return {"statistics": statistics(routed)}
    if kind == "detailed":
        return {"data": routed, "summary": statistics(routed)}
    if kind == "chart":
        return {"chart": chart_series(routed)}
    return {}
