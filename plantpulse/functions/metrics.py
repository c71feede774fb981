"""Aggregate columns per metric, and the open metric map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.functions.columns import as_col
from plantpulse.schemas import METRICS


def routed_columns(metrics) -> list[Column]:
    """Averages and extremes for the chosen metrics; pressure is averaged only."""
    columns = []
    for name in distinct_known(metrics):
        columns.append(F.avg(name).alias(f"avg_{name}"))
        if name != "pressure":
            columns.append(F.max(name).alias(f"max_{name}"))
            columns.append(F.min(name).alias(f"min_{name}"))
    return columns


def full_columns(metrics=METRICS) -> list[Column]:
    """Average, maximum and minimum of every metric."""
    return [
        fn(name).alias(f"{label}_{name}")
        for name in metrics
        for label, fn in (("avg", F.avg), ("max", F.max), ("min", F.min))
    ]


def routed_names(metrics) -> list[str]:
    names = []
    for name in distinct_known(metrics):
        names.append(f"avg_{name}")
        if name != "pressure":
            names += [f"max_{name}", f"min_{name}"]
    return names


def distinct_known(metrics) -> list[str]:
    """Lower-cased metrics that have a column, first mention first."""
    wanted = dict.fromkeys(m.lower() for m in metrics or [])
    return [m for m in wanted if m in METRICS]


def metric_map(*names, keep_nulls: bool = False) -> Column:
    """The metric map of a wide row. Missing metrics are absent keys unless `keep_nulls`."""
    names = names or METRICS
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return pairs if keep_nulls else F.map_filter(pairs, lambda _, v: v.isNotNull())


def metric_value(metrics, name: str) -> Column:
    """Value of one metric, NULL where the map or the key is missing."""
    return F.try_element_at(as_col(metrics), F.lit(name))


def with_metric(metrics, name: str, value) -> Column:
    """The map with one metric set; a missing map starts empty."""
    metrics = as_col(metrics)
    kept = F.coalesce(metrics, F.create_map().cast("map<string,double>"))
    kept = F.map_filter(kept, lambda k, _: k != name)
    return F.map_concat(kept, F.create_map(F.lit(name), as_col(value).cast("double")))


def long_form(readings: DataFrame, keep: list[str], metrics=METRICS) -> DataFrame:
    """One row per reading and present metric: `keep` columns, metric, value."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return (
        readings.select(*keep, F.inline(entries))
        .filter(F.col("value").isNotNull())
    )
