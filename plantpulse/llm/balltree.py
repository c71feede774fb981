"""Exact top-k search by inner product: one ball tree per shard, searched by branch and bound.

Vectors are dealt to cells by the nearest of a few pivots (a bounded sample) and cells are cut into shards of bounded
size by a hash, so that a third of all vectors being alike is many shards. A task builds the tree of a shard and packs it into one row.
Every query first searches its own shard, in blocks; the k-th score it finds there travels with it, and all other shards
open only balls whose bound reaches that score, best bound first, while the score keeps rising. A shard returns only hits that
reach the score, so few rows meet in the last ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.llm.common import saved, table

PIVOTS = 64
# Vectors of a shard, of a leaf of its tree, and queries of a block.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 16_384, 128, 256
_NO_ID, NONE = np.iinfo(np.int64).max, np.iinfo(np.int64).min

CELLS = "id bigint, query boolean, dim int, cell int, v binary"
SHARDS = "shard bigint, dim int, rows binary, ids binary, asks binary, vectors binary, starts binary, centres binary, radii binary"
BLOCKS = "shard bigint, dim int, rows binary, ids binary, vectors binary, floor binary"
HITS = "row bigint, query_id bigint, vec_id bigint, score bigint"


def whole_numbers(values: pa.Array, scale: float) -> tuple[np.ndarray, list]:
    """(usable, vectors): which rows of a list column are vectors of finite numbers, and floor(scale * x) of each of those."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    usable, out = np.zeros(len(values), bool), []
    for i, v in enumerate(values):
        if not v.is_valid or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            usable[i] = True
            with np.errstate(over="ignore"):
                out.append(np.nan_to_num(np.floor(x * scale)))
    return usable, out


def _dealt(scale: float, pivots: dict[int, np.ndarray]):
    def deal(batches):
        for batch in batches:
            usable, vectors = whole_numbers(batch.column("v"), scale)
            kept = batch.filter(pa.array(usable))
            cells = []
            for v in vectors:
                p = pivots.get(len(v))
                cells.append(0 if p is None else int(np.argmin((p * p).sum(1) - 2 * (p @ v))))
            yield pa.RecordBatch.from_arrays([
                kept.column("id"), kept.column("query"), pa.array([len(v) for v in vectors], pa.int32()),
                pa.array(cells, pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())],
                names=["id", "query", "dim", "cell", "v"])
    return deal


def _pivots(vectors: DataFrame, scale: float) -> dict[int, np.ndarray]:
    """Up to PIVOTS vectors, those of the least id hashes: they decide how alike the vectors of a shard are, never a result."""
    sample = vectors.select("v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toArrow()
    by_dim: dict[int, list] = {}
    for v in whole_numbers(sample.column("v"), scale)[1]:
        if np.abs(v).max(initial=0) < 1e100:
            by_dim.setdefault(len(v), []).append(v)
    return {d: np.unique(np.array(v), axis=0) for d, v in by_dim.items()}


def tree(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, centres, radii) of a balanced ball tree: leaf j holds vectors order[starts[j]:starts[j+1]].

    Nodes are kept as a heap: node i has children 2i+1 and 2i+2, the last half are the leaves. A node is cut at the
    median along the line through two far members, so equal vectors are no special case."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(vectors)) / leaf_rows))))
    parts, centres, radii = [np.arange(len(vectors))], [], []
    for level in range(depth + 1):
        below = []
        for part in parts:
            own = vectors[part]
            centre = own.mean(0) if len(part) else np.zeros(vectors.shape[1])
            far = ((own - centre) ** 2).sum(1)
            centres.append(centre)
            radii.append(np.sqrt(far.max(initial=0)))
            if level < depth:
                a = own[far.argmax()] if len(part) else centre
                line = own[((own - a) ** 2).sum(1).argmax()] - a if len(part) else centre
                half = np.argsort(own @ line, kind="stable")
                below += [part[half[:len(part) // 2]], part[half[len(part) // 2:]]]
        parts = below if level < depth else parts
    return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts]), np.array(centres), np.array(radii)


class Best:
    """The k best (score, id) of each query, scores descending, then ids ascending; NONE where there are fewer."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), NONE, np.int64)
        self.ids = np.full((queries, k), _NO_ID, np.int64)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        ids = np.concatenate([self.ids[which], np.broadcast_to(ids, scores.shape)], 1)
        scores = np.concatenate([self.scores[which], scores], 1)
        if scores.shape[1] > 4 * k:  # only those that reach the k-th score, ties included, need the exact order
            down = ~scores
            width = int((down <= np.partition(down, k - 1, 1)[:, k - 1:k]).sum(1).max())
            best = np.argpartition(down, min(width, down.shape[1]) - 1, 1)[:, :width]
            scores, ids = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
        order = np.lexsort((ids, ~scores), axis=1)[:, :k]
        self.scores[which] = np.take_along_axis(scores, order, 1)
        self.ids[which] = np.take_along_axis(ids, order, 1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as longs. They are exact in doubles while they stay below 2^53 in sum; beyond,
    Python's integers compute them and they are held in the range of a long."""
    size = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    if size < 2.0 ** 53:
        return (queries @ vectors.T).astype(np.int64)
    left, right = ([[int(x) for x in v] for v in side] for side in (queries, vectors))
    exact = [[sum(a * b for a, b in zip(q, v)) for v in right] for q in left]
    return np.array([[min(max(x, int(NONE) + 1), 2 ** 63 - 1) for x in row] for row in exact], np.int64)


def search(shard: dict, queries: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The k best of a shard for each query, of those that reach its floor. A ball with a bound below the floor stays
    shut; the floor rises as hits are found. A query's own row is no candidate."""
    vectors, starts = shard["vectors"], shard["starts"]
    norm = np.sqrt((queries ** 2).sum(1))
    best, floor, asks = Best(len(queries), k), floor.copy(), np.arange(len(queries))
    bound = queries @ shard["centres"].T + norm[:, None] * shard["radii"]
    bound += 1e-9 * (np.abs(bound) + norm[:, None] * (shard["radii"] + np.sqrt((shard["centres"] ** 2).sum(1)))) + 1e-6
    leaves = len(starts) - 1
    # from the root down: below a ball that no query needs, no ball is looked at
    alive = np.ones((len(queries), 1), bool)
    node = 0
    while True:
        alive &= bound[:, node:node + alive.shape[1]] >= floor[:, None]
        if alive.shape[1] == leaves:
            break
        node = 2 * node + 1
        alive = np.repeat(alive, 2, 1)
    bound = np.where(alive, bound[:, node:node + leaves], -np.inf)
    for leaf in np.argsort(-bound.max(0, initial=-np.inf), kind="stable"):
        which = asks[alive[:, leaf] & (bound[:, leaf] >= floor)]
        part = slice(starts[leaf], starts[leaf + 1])
        if not len(which) or part.start == part.stop:
            continue
        scores = products(queries[which], vectors[part])
        scores[rows[which][:, None] == shard["rows"][part]] = NONE
        reach = ((scores >= floor[which, None]) & (scores != NONE)).any(1)
        if reach.any():
            best.add(which[reach], scores[reach], shard["ids"][part])
            floor = np.maximum(floor, best.scores[:, -1])
    return best


def _built(batches):
    """Sorted rows (shard, dim, row, id, query, v) to one packed row per shard."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if mark is not None and shards[a] != mark:
                yield _packed(held)
                held = []
            mark = shards[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _packed(held)


def _packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    dim = rows.column("dim")[0].as_py()
    vectors = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64).reshape(rows.num_rows, dim)
    order, starts, centres, radii = tree(vectors)
    ids = rows.column("id").to_numpy()[order]
    asks = rows.column("query").to_numpy(zero_copy_only=False)[order]
    packed = [rows.column("row").to_numpy()[order], ids, asks, vectors[order], starts.astype(np.int64), centres, radii]
    return pa.RecordBatch.from_arrays(
        [rows.column("shard").slice(0, 1), pa.array([dim], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
        names=["shard", "dim", "rows", "ids", "asks", "vectors", "starts", "centres", "radii"])


def _shard(row: dict) -> dict:
    kinds = {"rows": np.int64, "ids": np.int64, "asks": bool, "starts": np.int64, "radii": np.float64}
    flat = {n: np.frombuffer(row[n], kind) for n, kind in kinds.items()}
    return {**flat, "vectors": np.frombuffer(row["vectors"], np.float64).reshape(len(flat["ids"]), row["dim"]),
            "centres": np.frombuffer(row["centres"], np.float64).reshape(len(flat["radii"]), row["dim"])}


def _first(k: int):
    """The queries of a shard in blocks, with the hits and the k-th score they find in their own shard."""
    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = _shard(row)
                at = np.flatnonzero(shard["asks"])
                for start in range(0, len(at), BLOCK_QUERIES):
                    own = at[start:start + BLOCK_QUERIES]
                    rows, ids, vectors = (shard[n][own] for n in ("rows", "ids", "vectors"))
                    best = search(shard, vectors, rows, np.full(len(own), NONE), k)
                    yield pa.RecordBatch.from_pylist([{
                        "shard": row["shard"], "dim": row["dim"], "rows": rows.tobytes(), "ids": ids.tobytes(), "vectors": vectors.tobytes(),
                        "floor": best.scores[:, -1].tobytes(), "hits": _hits(rows, ids, best)}], schema=_FIRST)
    return first


_HIT = pa.struct([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FIRST = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()),
                    ("vectors", pa.binary()), ("floor", pa.binary()), ("hits", pa.list_(_HIT))])


def _hits(rows: np.ndarray, ids: np.ndarray, best: Best) -> list[dict]:
    return [{"row": int(rows[q]), "query_id": int(ids[q]), "vec_id": int(best.ids[q, j]), "score": int(best.scores[q, j])}
            for q, j in np.argwhere(best.scores != NONE)]


def _others(k: int):
    """Pairs of a shard and a block of queries to the hits that reach the block's floors."""
    def others(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows, ids, floor = (np.frombuffer(row[f"q_{n}"], np.int64) for n in ("rows", "ids", "floor"))
                best = search(_shard(row), np.frombuffer(row["q_vectors"], np.float64).reshape(len(rows), row["dim"]), rows, floor, k)
                best.scores[best.scores < floor[:, None]] = NONE
                if hits := _hits(rows, ids, best):
                    yield pa.RecordBatch.from_pylist(hits, schema=pa.schema(list(_HIT)))
    return others


def top_k(df: DataFrame, id_col: str, vector: str, is_query: Column, k: int = 5, scale: float = 256.0,
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the highest inner product of floor(scale * x), all other
    rows being candidates; ties go to the smaller id.

    Vectors that are null or hold a null or a number that is not finite take no part; vectors meet only vectors of
    their own length. Rows may repeat: only the query's own row is left out, and two queries of one id get a list
    each. A row without an id can be found (vec_id null, last among ties) and asks only if `is_query` says so.
    Scores beyond a long are held at its range. No rows give no rows. Other columns take no part.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(_NO_ID))).alias("id"),
                     F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).alias("v"))
    dealt = rows.mapInArrow(_dealt(scale, _pivots(rows, scale)), CELLS)
    dealt = saved(dealt.withColumn("row", F.monotonically_increasing_id()), "ball-rows")
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / shard_rows))
    so_far = Window.orderBy("dim", "cell")  # one small row per cell: at most PIVOTS per length of vector
    cells = saved(cells.withColumn("base", F.sum("parts").over(so_far) - F.col("parts")), "ball-cells")
    spans = cells.groupBy("dim").agg(F.min("base").alias("low"), F.max(F.col("base") + F.col("parts") - 1).alias("high"))
    own = dealt.join(cells.select("dim", "cell", "base", "parts"), ["dim", "cell"])
    own = own.withColumn("shard", F.col("base") + F.pmod(F.xxhash64("row"), F.col("parts")))
    index = saved(own.select("shard", "dim", "row", "id", "query", "v").repartition("shard").sortWithinPartitions("shard", "row")
                  .mapInArrow(_built, SHARDS), "ball-index")
    blocks = saved(index.mapInArrow(_first(k), f"{BLOCKS}, hits array<struct<{HITS.replace(' bigint', ': bigint')}>>"), "ball-blocks")
    pairs = blocks.drop("hits").join(spans, "dim").withColumn("to", F.explode(F.sequence("low", "high"))).filter("to <> shard")
    pairs = pairs.select(F.col("to").alias("shard"), *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "vectors", "floor")])
    found = index.join(pairs, "shard").mapInArrow(_others(k), HITS)
    hits = blocks.select(F.explode("hits").alias("h")).select("h.*").unionByName(found)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return hits.select(*[F.when(F.col(c) != int(_NO_ID), F.col(c)).alias(c) for c in ("query_id", "vec_id")], "rank", "score") \
        .select("query_id", "rank", "vec_id", "score")


def query(spark, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
