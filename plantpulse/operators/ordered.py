"""Ordered computations that never put a busy key, or the whole table, into one task.

A plain window over a key sorts all rows of that key in one task. Here the time line of every busy key
is cut into chunks: the window runs per (key, chunk), and one small row per chunk carries what the next
chunk needs. A key that holds a third of the table is then spread over as many tasks as it has chunks.
Keys of ordinary size stay in one chunk each, so they pay almost nothing for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.functions.timefn import epoch_seconds
from plantpulse.operators.positions import picked
from plantpulse.session import pin

CHUNK = "__chunk"
WHOLE = -(1 << 62)  # chunk number of keys that are not cut; no time slot is that early
# A key is busy from this many rows on; the second figure bounds how many keys can be busy.
BUSY_ROWS = 1_000_000
MOST_BUSY_KEYS = 20_000
NO_TIME = -(1 << 61)  # chunk number of rows of a busy key that have no time


def with_chunk(df: DataFrame, keys: list[str], time: str, seconds: int, busy_rows: int | None = None) -> DataFrame:
    """Adds the chunk number: the time slot for busy keys, WHOLE for all others.

    A key is busy when it has more than `busy_rows` rows and more than 1/20,000 of all rows. So there
    are fewer than 20,000 busy keys whatever the size of the table, which is why they may be broadcast.
    """
    least = BUSY_ROWS if busy_rows is None else busy_rows
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    portion = sizes.agg(F.sum("__n")).scalar() / F.lit(MOST_BUSY_KEYS)
    busy = sizes.filter((F.col("__n") > least) & (F.col("__n") > portion)).select(*keys, F.lit(True).alias("__busy"))
    slot = F.coalesce(F.floor(epoch_seconds(time) / F.lit(seconds)).cast("bigint"), F.lit(NO_TIME))
    return (
        null_safe_join(df, F.broadcast(busy), keys)
        .withColumn(CHUNK, F.when(F.col("__busy"), slot).otherwise(F.lit(WHOLE))).drop("__busy"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a NULL key meets a NULL key; the keys of the left side stay."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(named, same, "left").drop(*[f"__right_{k}" for k in keys])


def islands(df: DataFrame, keys: list[str], time: str, tie: str, inside: str, chunk_seconds: int = 3600,
            busy_rows: int | None = None) -> DataFrame:
    """Maximal runs of rows with `inside` true, per key in (time, tie) order.

    Result: keys, start_time, end_time, readings. A run ends at the first row that is not inside.
    Rows are numbered by how many outside rows came before them: a local count per chunk, plus the
    total of the earlier chunks. Rows that carry a chunk number already keep it.
    """
    cut = df if CHUNK in df.columns else with_chunk(df, keys, time, chunk_seconds, busy_rows)
    group = [*keys, CHUNK]
    local = Window.partitionBy(*group).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    outside = F.when(F.col(inside), 0).otherwise(1)
    pieces = (
        cut.withColumn("__gap", F.sum(outside).over(local))
        .filter(F.col(inside))
        .groupBy(*group, "__gap")
        .agg(F.min(time).alias("__from"), F.max(time).alias("__to"), F.count("*").alias("__n"))
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # only keys with more than one chunk have earlier chunks
    gaps_before = (
        cut.filter(F.col(CHUNK) != WHOLE).groupBy(*group).agg(F.sum(outside).alias("__gaps"))
        .withColumn("__before", F.sum("__gaps").over(earlier)).drop("__gaps")
    )
    return (
        null_safe_join(pieces, gaps_before, group)
        .withColumn("__run", F.col("__gap") + F.coalesce("__before", F.lit(0)))
        .groupBy(*keys, "__run")
        .agg(F.min("__from").alias("start_time"), F.max("__to").alias("end_time"),
             F.sum("__n").alias("readings"))
        .drop("__run")
    )


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
                  time: str, chunk_seconds: int = 86400, busy_rows: int | None = None) -> DataFrame:
    """`lag(value)` per key in `order` (whose first column is `time`), split by time chunks."""
    cut = with_chunk(df, keys, time, chunk_seconds, busy_rows)
    group = [*keys, CHUNK]
    local = Window.partitionBy(*group).orderBy(*order)
    # wrapped in a struct, so that a NULL value is not mistaken for "no row before"
    own = F.lag(F.struct(F.col(value).alias("v"))).over(local)
    # only keys with more than one chunk have anything to carry
    busy = cut.filter(F.col(CHUNK) != WHOLE)
    last = busy.groupBy(*group).agg(F.max(F.struct(*order, F.col(value).alias("__v"))).alias("__last"))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = last.select(*group, F.lag(F.struct(F.col("__last.__v").alias("v"))).over(chunks).alias("__carried"))
    return (
        null_safe_join(cut.withColumn("__own", own), carried, group)
        .withColumn(name, F.coalesce("__own", "__carried")["v"])
        .drop("__own", "__carried", CHUNK)
    )


def with_row_index(df: DataFrame, order: list[Column | str], name: str = "row_index") -> tuple[DataFrame, int]:
    """Number the rows 0, 1, 2, ... in a total order; returns the rows and their count.

    Range-sorts once, pins the result, counts rows per partition and adds each partition's offset.
    Only one number per partition passes the driver.
    """
    pinned = pin(df.orderBy(*order))
    place = F.spark_partition_id()
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(pinned.groupBy(place.alias("p")).count().collect())
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), place + 1)
    return pinned.withColumn(name, offset + row), total


def total_order(df: DataFrame, order: list[str], descending: bool = False) -> list[Column]:
    """The order columns, then a hash of the whole row: every way of sorting by it gives the same rows, with
    NULLs and repeated keys, and rows that still tie are equal. NULLs come first, or last when descending."""
    tie = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order] + [tie]


def rows_at(df: DataFrame, order: list[str], ranges, descending: bool = False) -> tuple[DataFrame, int]:
    """(rows, number of all rows): the rows whose position in the total order lies in one of `ranges(total)`, in order.

    The rows themselves are returned, so nothing is looked up again by columns that may be NULL or repeat. Only
    the order columns of the whole table are read; see `positions`. A hash over all columns is added where
    rows tie, so that the answer has one meaning.
    """
    tie = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    rows, total = picked(df.withColumn("__tie", tie), order, ranges, "__tie", descending)
    return rows.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order], "__tie").drop("__tie"), total
