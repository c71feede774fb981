"""Ball-tree search against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from plantpulse.llm import balltree

SCHEMA = "vec_id bigint, embedding array<double>, row string, shard int, score string"


def brute(rows, k=5, every=5):
    usable = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(usable):
        if q is None or q % every:
            continue
        found = sorted(((-sum(a * b for a, b in zip(v, w)), (i is None, i or 0), i) for m, (i, w) in enumerate(usable) if m != n and len(v) == len(w)))
        out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, shard_rows, every=5):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted(map(tuple, balltree.top_k(df, "vec_id", "embedding", F.col("vec_id") % every == 0, shard_rows=shard_rows).collect()), key=repr)


def test_top_k_with_ties_nulls_and_other_lengths(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # copies
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0]), (310, [float("nan"), 0.0, 0.0, 0.0]), (315, [float("inf")] * 4)]
    rows += [(320, [1.0]), (321, [2.0]), (325, []), (5, [0.5] * 4), (None, [9.0] * 4), (400, [1e200] * 4), (405, [3e9, -3e9, 1.0, 0.0])]
    want = brute(rows)
    clipped = sorted(((q, n, i, max(min(s, 2 ** 63 - 1), -2 ** 63 + 1)) for q, n, i, s in want), key=repr)
    got = found(spark, rows, 32)
    # where scores leave the range of a long their order is lost, never the hits within it
    inside = [x for x in clipped if abs(x[3]) < 2 ** 62 and x[0] not in (400, 405)]
    assert [x for x in got if x in set(inside)] == inside


def test_top_k_exact_in_many_shards(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), (v * (3 if i % 7 == 0 else 1)).tolist()) for i, v in enumerate(r.normal(size=(600, 8)))]
    assert found(spark, rows, 100) == brute(rows)


def test_top_k_few_rows_and_none(spark):
    assert found(spark, [], 10) == []
    assert found(spark, [(0, [1.0])], 10) == []
    assert found(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])], 10) == brute([(0, [1.0]), (0, [1.0]), (1, [2.0])])


def test_closed_balls_lose_nothing():
    r = np.random.default_rng(2)
    vectors = np.floor(256 * np.concatenate([r.normal(size=(3000, 6)), np.tile(r.normal(size=(1, 6)), (1000, 1))]))
    order, starts, centres, radii = balltree.tree(vectors, 32)
    assert sorted(order) == list(range(len(vectors))) and starts[-1] == len(vectors)
    shard = {"vectors": vectors[order], "starts": starts, "centres": centres, "radii": radii, "ids": order, "rows": order}
    queries = vectors[::97]
    best = balltree.search(shard, queries, np.arange(0, len(vectors), 97), np.full(len(queries), balltree.NONE), 5)
    scores = (queries @ vectors.T).astype(np.int64)
    scores[np.arange(len(queries)), np.arange(0, len(vectors), 97)] = balltree.NONE
    want = np.lexsort((np.broadcast_to(np.arange(len(vectors)), scores.shape), ~scores), axis=1)[:, :5]
    assert (best.ids == want).all()
