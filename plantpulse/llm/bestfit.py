"""Best-fit packing improved by swap-based local search.

Documents become token pieces of at most `width` ids (see tokens.pieces). A task packs the pieces of its partition by
best fit in decreasing order. Then the underfull sequences are searched: a piece is moved, or exchanged for one or for
two pieces of a less filled sequence, whenever that brings more tokens into the fuller one. Each step raises the sum of
squared fills, so the search ends; sequences that lose all their pieces are dropped.

What is still underfull goes on to the next round, dealt into a quarter of the partitions, until the pieces of one task
remain. Full sequences never move again, so each round is a small part of the one before. No piece is dropped.

Defined cases: a null or empty text is one piece that holds the end id alone. Repeated rows are packed each on their
own. Null ids are carried. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from plantpulse.llm.common import saved
from plantpulse.llm.tokens import pieces

WIDTH = 1024
# Pieces that one task may hold in a round after the first; 40 bytes each.
TASK_PIECES = 1_000_000
# Pieces of one size that a search step looks at; how far a step looks, not which pieces take part.
PROBES = 8


def best_fit(sizes: np.ndarray, width: int) -> tuple[list[list[int]], list[int]]:
    """Sequences (lists of piece numbers) and their fills; largest pieces first, each into the fullest that takes it."""
    bins: list[list[int]] = []
    fills: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(width + 1)]  # sequences by free room
    rooms = 0  # bit r: some sequence has room r
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
            bins[b].append(int(i))
            fills[b] += size
        else:
            b, room = len(bins), width
            bins.append([int(i)])
            fills.append(size)
        left = room - size
        if left:
            open_at[left].append(b)
            rooms |= 1 << left
    return bins, fills


class _Pool:
    """Pieces of the underfull sequences, found by size."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], fills: list[int], members: list[int]):
        self.sizes, self.bins, self.fills = sizes, bins, fills
        self.where: dict[int, int] = {}
        self.by_size: dict[int, list[int]] = {}
        self.ordered: list[int] = []
        for b in members:
            for i in bins[b]:
                self.where[i] = b
                self.by_size.setdefault(int(sizes[i]), []).append(i)
        self.ordered = sorted(self.by_size)

    def find(self, size: int, least: int, barred: int, fill: int) -> int | None:
        """A piece of at most `size` and more than `least` ids, from a sequence no fuller than `fill`."""
        at = bisect_right(self.ordered, size) - 1
        while at >= 0 and self.ordered[at] > least:
            for i in self.by_size[self.ordered[at]][-PROBES:]:
                b = self.where[i]
                if b != barred and self.fills[b] <= fill:
                    return i
            at -= 1
        return None

    def find_pair(self, first: int, size: int, least: int, barred: int, fill: int) -> list[int] | None:
        """A piece of `first` ids and another of its sequence, of at most `size` and more than `least` ids."""
        for i in self.by_size[first][-PROBES:]:
            b = self.where[i]
            if b != barred and self.fills[b] <= fill:
                for j in self.bins[b]:
                    if j != i and least < self.sizes[j] <= size:
                        return [i, j]
        return None

    def move(self, i: int, to: int) -> None:
        old, size = self.where[i], int(self.sizes[i])
        self.bins[old].remove(i)
        self.bins[to].append(i)
        self.fills[old] -= size
        self.fills[to] += size
        self.where[i] = to

    def retire(self, b: int) -> None:
        """A full sequence leaves the search."""
        for i in self.bins[b]:
            size = int(self.sizes[i])
            self.by_size[size].remove(i)
            if not self.by_size[size]:
                del self.by_size[size]
                self.ordered.remove(size)
            del self.where[i]


def _improve(pool: _Pool, b: int, width: int) -> bool:
    """One step that fills sequence `b` further: the one that leaves the least room."""
    sizes, gap, fill = pool.sizes, width - pool.fills[b], pool.fills[b]
    best, gain = None, 0
    single = pool.find(gap, gain, b, fill)
    if single is not None:
        best, gain = ([], [single]), int(sizes[single])
    seen = set()
    for a in pool.bins[b]:
        own = int(sizes[a])
        if gain == gap:
            break
        if own in seen:
            continue
        seen.add(own)
        other = pool.find(own + gap, own + gain, b, fill)
        if other is not None:
            best, gain = ([a], [other]), int(sizes[other]) - own
        if gain == gap:
            break
        for first in pool.ordered:  # two for one
            if 2 * first > own + gap:
                break
            pair = pool.find_pair(first, own + gap - first, own + gain - first, b, fill)
            if pair is not None:
                best, gain = ([a], pair), sum(int(sizes[i]) for i in pair) - own
                if gain == gap:
                    break
    if best is None:
        return False
    source = pool.where[best[1][0]]
    for i in best[1]:
        pool.move(i, b)
    for a in best[0]:
        pool.move(a, source)
    return True


def local_search(sizes: np.ndarray, bins: list[list[int]], fills: list[int], width: int) -> None:
    """Improve underfull sequences in place, the fullest first; emptied ones stay as empty lists."""
    members = [b for b in range(len(bins)) if 0 < fills[b] < width]
    pool = _Pool(sizes, bins, fills, members)
    for b in sorted(members, key=lambda b: -fills[b]):
        while bins[b] and fills[b] < width and _improve(pool, b, width):
            pass
        if bins[b]:
            pool.retire(b)


def pack_sizes(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, fill of the sequence) of every piece."""
    bins, fills = best_fit(sizes, width)
    local_search(sizes, bins, fills, width)
    n = len(sizes)
    sequence, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, (b, total) in enumerate((b, f) for b, f in zip(bins, fills) if b):
        at = 0
        for i in sorted(b):
            sequence[i], offset[i], fill[i] = k, at, total
            at += int(sizes[i])
    return sequence, offset, fill


def _pack_partitions(rows: DataFrame, width: int, level: int) -> DataFrame:
    schema = StructType([f for f in rows.schema.fields if f.name not in ("sequence_id", "offset", "full")] + [
        StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("full", BooleanType())])
    names = [f.name for f in schema.fields][:-3]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b.select(names) for b in batches if len(b)]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        sequence, offset, fill = pack_sizes(table["length"].to_numpy(), width)
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        for name, values in (("sequence_id", sequence + first), ("offset", offset), ("full", fill == width)):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(max_chunksize=10_000)

    return rows.mapInArrow(pack, schema)


def pack_pieces(rows: DataFrame, width: int = WIDTH, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Rows with a `length` of at most `width`, plus sequence_id (any numbers) and offset (gapless from 0)."""
    now = saved(_pack_partitions(rows, width, 0), "packed")
    tasks, level, done = rows.rdd.getNumPartitions(), 0, []
    while True:
        left = now.filter("NOT full")
        fewer = max(1, tasks // 4, -(-left.count() // task_pieces))
        if fewer >= tasks:
            break
        done.append(now.filter("full"))
        tasks, level = fewer, level + 1
        dealt = left.drop("sequence_id", "offset", "full").repartition(tasks)
        now = saved(_pack_partitions(dealt, width, level), "packed")
    for part in done:
        now = now.unionByName(part)
    return now.drop("full")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", file: str | None = None,
                   width: int = WIDTH, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset of every piece of every document."""
    return pack_pieces(saved(pieces(docs, doc_id, text, file, width, end_id, with_ids), "pieces"), width)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packing plan of the documents that are left."""
    return pack_documents(docs)


def query(spark, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"))
