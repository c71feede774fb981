"""Places of rows within groups, without a window over a group: one range sort, then one small row per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.llm.common import saved


def sorted_rows(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """All rows in ascending order (nulls first) over tasks and within them, written to the shared folder.

    Adds `at`, which ascends in that order, and `part`, the task that sorted the row. Rows that tie keep the place
    they had in the input, so a third of all rows being equal does not fill one task.
    """
    out = df.withColumn("__src", F.monotonically_increasing_id())
    out = out.repartitionByRange(*order, "__src").sortWithinPartitions(*order, "__src")
    out = out.drop("__src").withColumn("at", F.monotonically_increasing_id())
    return saved(out.withColumn("part", F.shiftright("at", 33)), label)


def runs(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per group and task that holds rows of it: `first` (its least `at`), `n_run`, `before` (rows of the
    group in earlier tasks), `n_group`. A group has at most as many runs as there are tasks."""
    found = rows.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n_run"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumns({"before": F.coalesce(F.sum("n_run").over(earlier), F.lit(0)),
                              "n_group": F.sum("n_run").over(whole)})


def with_runs(rows: DataFrame, table: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the columns of their run; nulls are a group like any other."""
    right = table.select(*[F.col(c).alias(f"__{c}") for c in (*group, "part")],
                         *[c for c in table.columns if c not in (*group, "part")])
    same = F.lit(True)
    for c in (*group, "part"):
        same = same & rows[c].eqNullSafe(right[f"__{c}"])
    return rows.join(right, same).drop(*[f"__{c}" for c in (*group, "part")])


def ranked(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Adds `rank` (from 0, by `order` within `group`) and `n_group`."""
    rows = sorted_rows(df, [*group, *order], label)
    out = with_runs(rows, runs(rows, group), group)
    return out.withColumn("rank", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "n_run", "before")
