"""Rows by their position in an order, without sorting or storing the table.

A bounded sample of the leading order column gives splitters; one pass over the order columns counts the rows of every
range between two splitters and of every splitter itself, exactly. The counts say which ranges hold the asked positions; only those are
read with all columns and sorted, each by itself. A value that fills a range of its own (a hot value, or NULL) is
ordered by the next column, and a range that is still large is cut again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows sampled for splitters, ranges between them, and rows of a range up to which it is sorted in one task.
SAMPLE_ROWS, FANOUT, RANGE_ROWS = 8192, 16, 4_000_000
# Asked ranges of positions up to which they travel as literals.
MOST_RANGES = 10_000


def _splitters(df: DataFrame, column: str, order: list[str]) -> list:
    """Up to FANOUT * FANOUT - 1 different values of the column, ascending, as text, from the rows of the least order hashes."""
    rows = df.filter(F.col(column).isNotNull()).select(column, F.xxhash64(*order).alias("__h"))
    found = [r[0] for r in rows.orderBy("__h").limit(SAMPLE_ROWS).orderBy(column).select(F.col(column).cast("string")).collect()]
    step = max(1, len(found) // (FANOUT * FANOUT))
    out: list = []
    for value in found[step - 1::step]:
        if not out or value != out[-1]:
            out.append(value)
    return out[:FANOUT * FANOUT - 1]


def _range_of(column: str, kind, splitters: list) -> Column:
    """0 for NULL, 2i+1 for values between splitters i-1 and i, 2i+2 for splitter i itself."""
    x = F.col(column)

    def literal(values: list) -> Column:
        return F.lit(values).cast(f"array<{kind.simpleString()}>") if values else F.array().cast(f"array<{kind.simpleString()}>")

    block = F.greatest(F.size(F.filter(literal(splitters[::FANOUT]), lambda s: s <= x)), F.lit(1))
    own = F.slice(literal(splitters), (block - 1) * FANOUT + 1, F.lit(FANOUT))
    below = (block - 1) * FANOUT + F.size(F.filter(own, lambda s: s < x))
    return F.when(x.isNull(), 0).otherwise(2 * below + 1 + F.array_contains(own, x).cast("int"))


def _needed(counts: dict[int, int], ranges: list[tuple[int, int]], descending: bool) -> dict[int, list[tuple[int, int]]]:
    """For every range of values the positions asked within it (first, last)."""
    out: dict[int, list[tuple[int, int]]] = {}
    start, asked = 0, sorted(ranges)
    for number in sorted(counts, reverse=descending):
        end = start + counts[number]
        for low, high in asked:
            if low < end and high >= start:
                out.setdefault(number, []).append((max(low, start) - start, min(high, end - 1) - start))
        start = end
        asked = [r for r in asked if r[1] >= start]
    return out


def picked(df: DataFrame, order: list[str], ranges, tie: str, descending: bool = False, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """(rows at the asked positions, number of all rows). `ranges(total)` gives (first, last) pairs of positions from 0
    in the order of `order` (NULLs first, or last when descending) and then of `tie` (a column of 64-bit hashes,
    ascending): rows that tie in all of them are equal. No more than MOST_RANGES pairs."""
    column, kind = order[0], df.schema[order[0]].dataType
    splitters = _splitters(df, column, [*order, tie])
    cut = df.withColumn("__range", _range_of(column, kind, splitters))
    counts = {r[0]: r[1] for r in cut.groupBy("__range").count().collect()}
    total = sum(counts.values())
    asked = ranges(total)
    if len(asked) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges of positions")
    needed = _needed(counts, asked, descending)
    out, sortable = df.limit(0), {}
    for number, local in needed.items():
        if counts[number] <= range_rows:
            sortable[number] = local
            continue
        inside = cut.filter(F.col("__range") == number).drop("__range")
        one_value = number % 2 == 0
        if one_value and len(order) > 1:
            more = picked(inside, order[1:], lambda _, local=local: local, tie, descending, range_rows)[0]
        elif one_value:
            # the last column ties: the hash decides, always ascending; if it ties too, the rows are equal
            if column == tie:
                more = inside.limit(sum(high - low + 1 for low, high in local))
            else:
                more = picked(inside, [tie], lambda _, local=local: local, tie, False, range_rows)[0]
        elif counts[number] < total:
            more = picked(inside, order, lambda _, local=local: local, tie, descending, range_rows)[0]
        else:
            sortable[number] = local
            continue
        out = out.unionByName(more)
    if sortable:
        inside = cut.filter(F.col("__range").isin(sorted(sortable)) & _bounds(column, kind, splitters, sortable))
        place = F.row_number().over(Window.partitionBy("__range").orderBy(*_sorting(order, tie, descending))) - 1
        spans = df.sparkSession.createDataFrame(
            [(n, low, high) for n, local in sortable.items() for low, high in local], "__range int, __low bigint, __high bigint")
        rows = inside.withColumn("__place", place).join(F.broadcast(spans), "__range")  # at most MOST_RANGES rows and ranges
        rows = rows.filter(F.col("__place").between(F.col("__low"), F.col("__high")))
        out = out.unionByName(rows.select(*df.columns))
    return out, total


def _sorting(order: list[str], tie: str, descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending and c != tie else F.col(c).asc() for c in order] + [F.col(tie)]


def _bounds(column: str, kind, splitters: list, needed) -> Column:
    """A plain bound on the leading column, for the scan to skip what no needed range can hold."""
    if 0 in needed or not splitters:
        return F.lit(True)
    low, high = min(needed), max(needed)
    keep = F.lit(True)
    if low >= 2:
        keep = keep & (F.col(column) >= F.lit(splitters[(low - 2) // 2]).cast(kind))
    if (high - 1) // 2 < len(splitters):
        keep = keep & (F.col(column) <= F.lit(splitters[(high - 1) // 2]).cast(kind))
    return keep
