"""The Jaccard join, decontamination and components against brute force."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import graph, jaccard, leaks, words


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    out, now = [], ""
    for c in low(text):
        if c in " \t\n\x0b\x0c\r":
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def shingle_set(text, width=5):
    w = spaced(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), i if not s else least.get(find(k))) for k, (i, s) in enumerate(sets)]


def corpus(seed=1, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 120]))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[:5] + passage + t[5:]
            out.append(" ".join(t))
    return out + [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f", out[0], out[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("limits", [{}, {"most_rows": 3, "pivots": 2}], ids=["in tasks", "cut by Spark"])
def test_components_match_brute_force(spark, limits):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(corpus(3, 8))] + [(None, "one two"), (None, "nothing like the others at all here")]
    got = [tuple(r) for r in jaccard.near_duplicates(frame(spark, rows), **limits).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_region_join_connects_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    for trial in range(60):
        base = rng.integers(0, 200, 40)
        sets = []
        for _ in range(rng.integers(2, 25)):
            s = base.copy()
            s[rng.random(40) < rng.choice([0.02, 0.08, 0.2])] = rng.integers(0, 2000)
            s[rng.integers(0, 40, 4)] = rng.integers(0, 2000, 4)
            sets.append(np.unique(s))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        links = jaccard.join_region(np.concatenate(sets), bounds, np.ones(len(sets), bool), 0.25)
        near = {(a, b) for a in range(len(sets)) for b in range(len(sets))
                if a != b and 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b]))}
        assert all((a, b) in near for a, b in links)

        def parts(edges):
            of = list(range(len(sets)))
            for a, b in edges:
                of = [of[a] if x == of[b] else x for x in of]
            return {tuple(i for i, x in enumerate(of) if x == r) for r in of}
        assert parts(links) == parts(near), trial


def test_stage_keeps_one_of_each_group(spark):
    text = "a text of some words that is long enough for several shingles and more"
    rows = [(5, text, 1), (3, text + " end", 2), (9, "another thing " * 5, 3), (9, "another thing " * 5, 3), (None, text, 4), (7, None, 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = jaccard.stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [3, 7, 8, 9]


def test_stage_tells_rows_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(20)) for w in "abc")
    rows = [(1, a), (1, b), (1, b), (42, c), (None, None), (None, None), (2, a)]
    got = sorted(map(tuple, jaccard.stage(spark, frame(spark, rows), "").collect()), key=str)
    assert got == sorted([(1, a), (1, b), (42, c), (None, None)], key=str)


def test_empty_tables(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaks.contamination(frame(spark, []), items).count() == 0
    assert leaks.contamination(frame(spark, [(1, "some words")]), items).first().n_hit == 0


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[201] == 200


def test_word_hashes_do_not_depend_on_their_place():
    texts = ["aa bb", "xaa bb cc", "", "\n aa\tbb ", "cc", "é" * 10 + " aa"]
    data, offsets = words.text_bytes(pa.array(texts))
    h, rows, starts, ends = words.hash_words(data, offsets, words.SPACED)
    found = {}
    for k in range(len(h)):
        found.setdefault(bytes(data[starts[k]:ends[k]]), set()).add(int(h[k]))
    assert all(len(v) == 1 for v in found.values()) and len({min(v) for v in found.values()}) == len(found)
    assert rows.tolist() == [0, 0, 1, 1, 1, 3, 3, 4, 5, 5]


def test_long_texts_hash_like_short_ones(monkeypatch):
    monkeypatch.setattr(words, "PIECE_BYTES", 64)
    text = " ".join(f"w{i}" for i in range(200)) + " " + "z" * 500 + " end " + "z" * 500
    data, offsets = words.text_bytes(pa.array([text, "w7 end"]))
    words._TABLES.clear()
    h, rows, _, _ = words.hash_words(data, offsets, words.SPACED)
    words._TABLES.clear()
    assert h[200] == h[202] and h[7] == h[203] and h[201] == h[204] and len(h) == 205


# ---- decontamination ----

def item_words(text):
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low(text)).split(" ")


def brute_hits(docs, items):
    cut = {i: [w for w in item_words(t) if w] for i, t in items}
    out = {}
    for d, t in docs:
        own, hit, found = [w for w in item_words(t) if w], set(), set()
        for i, w in cut.items():
            n = min(10, len(w))
            for window in {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else ():
                for p in range(len(own) - n + 1):
                    if tuple(own[p:p + n]) == window:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        out[d] = (len(own), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [250_000, 7])
def test_decontamination_matches_brute_force(spark, block):
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "gamma", "Δelta", "e2", "zeta"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([14, 10, 12, 3, 1, 2, 0, 25])]
    items += [(20, None), (21, "alpha, alpha! alpha alpha alpha alpha alpha alpha alpha alpha alpha alpha")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(25)]
    docs += [(100 + k, "start " + t.upper() + " end") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, "alpha " * 300)]
    got = leaks.contamination(
        frame(spark, docs).withColumn("N_HIT", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    want = brute_hits(docs, items)
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids) == want[r.doc_id], r.doc_id
        assert sum(s.end - s.start for s in r.hit_spans) == r.n_hit


def test_items_without_an_id(spark):
    items = spark.createDataFrame([(None, "alpha beta"), (3, "alpha beta")], "item_id long, text string")
    assert leaks.contamination(frame(spark, [(1, "x Alpha, beta")]), items).first().item_ids == ["", "3"]


def test_decontamination_stage(spark, tmp_path):
    leak = " ".join(f"word{i}" for i in range(15))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "x " + leak, 0), (2, "clean words", 1), (2, "clean words", 1), (3, None, 2)], "doc_id long, text string, n_hit int")
    got = leaks.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted((r.doc_id, r.n_hit) for r in got.collect()) == [(2, 1), (2, 1), (3, 2)]


def test_nodes_without_enough_shared_shingles_are_not_moved(spark):
    lead = spark.createDataFrame([(1, 2, [10, 11, 12]), (2, 2, [10, 20, 21]), (3, 1, [30, 10]), (4, 1, [40])],
                                 "node bigint, least bigint, lead array<bigint>").coalesce(1)
    groups = spark.createDataFrame([(10,), (11,)], "shingle bigint")
    got = sorted(map(tuple, jaccard._thinned(lead, groups).collect()))
    assert got == [(1, 2, 10), (1, 2, 11), (3, 1, 10)]


def test_the_popularity_sketch_passes_the_driver_as_levels(spark):
    """8 MB of levels; counters and what is computed from them took ten times that in the driver's Python."""
    texts = ["a b c d e f", "a b c d e g", "a b c d e", None, "x y"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tracemalloc.start()
    levels = jaccard.popularity(docs, "text")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    counts = np.zeros(1 << jaccard.SKETCH_BITS, np.int64)
    for _, h, _ in jaccard._shingle_slices(pa.RecordBatch.from_pydict({"text": texts}), "text", jaccard.WIDTH):
        np.add.at(counts, h & np.uint64(len(counts) - 1), 1)
    assert counts.max() == 9 and (levels == np.round(64 * np.log2(counts + 1)).astype(np.uint16)).all()


def test_workers_hold_little_at_once(spark, monkeypatch):
    """Tables and passes over 2 MB of text took some 190 MB of a worker, batches came with up to 64 MB."""
    texts = [" ".join(f"w{i * k % 9973}" for k in range(3000)) for i in range(500)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    monkeypatch.setattr(words, "_TABLES", {})
    tracemalloc.start()
    n = sum(len(b) - 1 for _, _, b in jaccard._shingle_slices(batch, "text", jaccard.WIDTH))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and batch.nbytes > 8 << 20 and most < 40 << 20

    sizes, real, key = [], jaccard.popularity, "spark.sql.execution.arrow.maxBytesPerBatch"

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "rows"])

    def watched(docs, *rest):
        sizes.extend(docs.select("text").mapInArrow(measure, "size long, rows long").collect())
        return real(docs, *rest)

    monkeypatch.setattr(jaccard, "popularity", watched)
    docs = frame(spark, [*enumerate(texts), (900, "long " * (6 << 18)), (901, texts[7])]).coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert len(got) == 502 and got[901] == 7 and sum(r.rows for r in sizes) == 502
    assert max(r.size for r in sizes if r.rows > 1) < 16 << 20 and spark.conf.get(key, None) is None
