"""Token-id matrices: best-fit-decreasing packing found by a segment tree, written as rows of equal width.

A task tokenizes its documents, cuts longer ones into pieces without loss, gathers `BLOCK_PIECES` pieces (or
`BLOCK_IDS` ids) and packs them: pieces by decreasing length, each into the row with the least room that takes it. The
segment tree holds, over all room sizes, how many open rows have that room, so the best fit is one descent. Nothing is
shuffled, memory is bounded by the block whatever the texts are, and a lost task starts again from its input.

A row holds `ids` (width little-endian numbers, 16-bit if the vocabulary fits, else 32-bit, padded at the end),
`cu_seqlens` (0, then where each piece ends), `position_ids` (restarting at 0 with each piece, 0 in the padding), and
for each piece the document, its number and where it starts in the document.

Defined cases: a null or empty text is one piece that holds the end id alone. Repeated rows are packed each on their
own. Null ids are carried. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from plantpulse.llm.tokens import Encoder, cut, default_file, document_ids

WIDTH = 2048
# What a task gathers before it packs; a block leaves about one row partly empty.
BLOCK_PIECES, BLOCK_IDS = 16_384, 8 << 20


class RoomTree:
    """Open rows by their room, with the least room of at least some size found in one descent."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, room) of the tightest open row with room for `size`; it is no longer open."""
        at = self.leaves + size
        if not self.count[at]:
            # up to the first subtree on the right that holds a row, then down its left edge
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_rows(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of piece numbers, longest pieces first."""
    tree, rows = RoomTree(width), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            row, room = len(rows), width
            rows.append([])
        else:
            row, room = found
        rows[row].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], row)
    return rows


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def packed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", file: str | None = None,
                width: int = WIDTH, end_id: int = 2, pad_id: int = 0) -> DataFrame:
    """row_id, n_ids, ids, cu_seqlens, position_ids, doc_ids, pieces, starts: all ids of all documents."""
    file = file or default_file()
    kind = docs.schema[doc_id].dataType
    schema = StructType([
        StructField("row_id", LongType()), StructField("n_ids", IntegerType()), StructField("ids", BinaryType()),
        StructField("cu_seqlens", ArrayType(IntegerType())), StructField("position_ids", BinaryType()),
        StructField("doc_ids", ArrayType(kind)), StructField("pieces", ArrayType(IntegerType())),
        StructField("starts", ArrayType(LongType()))])
    ramp = np.arange(width, dtype=id_type(width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(file)
        dtype = id_type(encoder.size)
        row_id = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        held_ids = 0

        def flush() -> pa.RecordBatch:
            nonlocal row_id
            out = []
            for members in best_fit_rows([len(p[3]) for p in held], width):
                own = [held[i] for i in sorted(members)]
                ends = np.cumsum([len(p[3]) for p in own])
                ids, places = np.full(width, pad_id, dtype), np.zeros(width, ramp.dtype)
                ids[:ends[-1]] = np.concatenate([p[3] for p in own])
                places[:ends[-1]] = np.concatenate([ramp[:len(p[3])] for p in own])
                out.append((row_id, int(ends[-1]), ids.tobytes(), [0, *ends.tolist()], places.tobytes(),
                            [p[0] for p in own], [p[1] for p in own], [p[2] for p in own]))
                row_id += 1
            held.clear()
            types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), None, pa.list_(pa.int32()),
                     pa.list_(pa.int64())]
            types[5] = pa.list_(id_arrow)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), types)], [f.name for f in schema.fields])

        for batch in batches:
            id_arrow = batch.schema.field("doc_id").type
            for doc, body in zip(batch.column("doc_id"), batch.column("text")):
                ids = document_ids(body.as_py(), encoder, end_id).astype(dtype)
                name = doc.as_py()
                for k, (start, length) in enumerate(cut(len(ids), width)):
                    held.append((name, k, start, ids[start:start + length]))
                    held_ids += length
                    if len(held) >= BLOCK_PIECES or held_ids >= BLOCK_IDS:
                        yield flush()
                        held_ids = 0
        if held:
            yield flush()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, schema)


def write_rows(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet files."""
    packed_rows(docs, **options).write.parquet(path)


def matrix(batch: pa.RecordBatch, width: int, vocabulary: int) -> np.ndarray:
    """The ids of a batch of rows as one matrix, without copying."""
    column = batch.column("ids")
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    body = np.frombuffer(column.buffers()[2], id_type(vocabulary), len(column) * width, int(start))
    return body.reshape(len(column), width)


def query(spark, folder: str) -> DataFrame:
    return packed_rows(spark.read.parquet(f"{folder}/documents.parquet"))
