"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

Every run of `window` words of an item is a set of shorter shingles that a document must contain whole. For full
containment one shingle is a sufficient prefix, so each window is looked up by its rarest one; rarity is counted
over all documents. A document word that starts such a shingle proposes the windows that hold it, the shingle's
place in the window gives the only possible position, the document's length bounds it, and the words are then
compared one by one. Words are compared as 64-bit hashes.

Item windows are the stated query set: they are cut into blocks of at most `BLOCK_WINDOWS` (window, item) pairs,
each block is broadcast, and documents are read once per block without any shuffle. Memory is bounded by the
block, work grows with documents x blocks.

Defined cases: a null or empty text has no words and no hits. A null item id is an empty one. An item without words has no window. An item shorter
than a window is one window of all its words. Repeated rows are judged alike, each on its own. An empty benchmark
hits nothing. Input columns stay; a column that has the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from plantpulse.llm import words
from plantpulse.llm.common import saved

WINDOW = 10
SHINGLE = 3
# Bound of what is broadcast: 100 bytes a window, 25 MB a block.
BLOCK_WINDOWS = 250_000
_PAIRS = 1 << 18
_MASK_BITS = 22


@dataclass
class Block:
    """Windows in order of their prefix token; `lengths` words of each row of `words` count."""
    items: list[str]
    words: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray | None = None
    places: np.ndarray | None = None
    widths: np.ndarray | None = None


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (item, words) of all windows; words as 64-bit hashes."""
    schema = StructType([StructField("item", StringType()), StructField("words", ArrayType(LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item").to_pylist()
            for first, data, offsets in words.slices(batch, "text"):
                h, rows, _, _ = words.hash_words(data, offsets, words.ALNUM)
                bounds = np.searchsorted(rows, np.arange(len(offsets)))
                out_items, out_words = [], []
                for r in range(len(offsets) - 1):
                    own = h[bounds[r]:bounds[r + 1]].astype(np.int64)
                    for i in range(max(len(own) - window + 1, 1 if len(own) else 0)):
                        out_items.append(names[first + r])
                        out_words.append(own[i:i + window])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_items, pa.string()), pa.array(out_words, pa.list_(pa.int64()))], ["item", "words"])

    slim = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, schema).distinct()


def _grams(w: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = words.windows(w, rows, width)
    return h ^ np.uint64(width), at


def _window_grams(block: Block) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(window, shingle, place) of every shingle; a window shorter than a shingle is one shingle."""
    out = []
    for width in range(1, SHINGLE + 1):
        use = np.flatnonzero(block.lengths >= SHINGLE if width == SHINGLE else block.lengths == width)
        last = int(block.lengths[use].max(initial=0)) - width
        for place in range(last + 1):
            sure = use[block.lengths[use] >= place + width]
            row = np.zeros(width, np.int64)
            g = np.array([], np.uint64) if not len(sure) else np.concatenate(
                [_grams(block.words[i, place:place + width], row, width)[0] for i in sure])
            out.append((sure, g, place, width))
    return out


def build_block(pdf) -> Block:
    lengths = np.array([len(x) for x in pdf["words"]], np.int64)
    table = np.zeros((len(pdf), int(lengths.max(initial=1))), np.uint64)
    for i, x in enumerate(pdf["words"]):
        table[i, :len(x)] = np.asarray(x, np.int64).astype(np.uint64)
    return Block(list(pdf["item"]), table, lengths)


def _mask(tokens: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << _MASK_BITS, bool)
    mask[tokens & np.uint64((1 << _MASK_BITS) - 1)] = True
    return mask


def _known(g: np.ndarray, mask: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Indexes of the shingles in g that are among the sorted tokens; the mask spares most lookups."""
    maybe = np.flatnonzero(mask[g & np.uint64((1 << _MASK_BITS) - 1)])
    if not len(tokens):
        return maybe[:0]
    place = np.minimum(np.searchsorted(tokens, g[maybe]), len(tokens) - 1)
    return maybe[tokens[place] == g[maybe]]


def shingle_counts(docs: DataFrame, text: str, tokens: np.ndarray, widths: list[int]) -> np.ndarray:
    """How often each token occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        mask, total = _mask(known), np.zeros(len(known), np.int64)
        for batch in batches:
            for _, data, offsets in words.slices(batch, "text"):
                h, rows, _, _ = words.hash_words(data, offsets, words.ALNUM)
                for width in widths:
                    g, _ = _grams(h, rows, width)
                    np.add.at(total, np.searchsorted(known, g[_known(g, mask, known)]), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["token", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "token bigint, n bigint")
    found = rows.groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # one row per token of the block at most
    out = np.zeros(len(tokens), np.int64)
    out[found["token"].to_numpy()] = found["n"].to_numpy()
    return out


def with_prefixes(block: Block, docs: DataFrame, text: str) -> Block:
    """The block sorted by the rarest shingle of each window."""
    grams = _window_grams(block)
    tokens = np.unique(np.concatenate([g for _, g, _, _ in grams] or [np.zeros(0, np.uint64)]))
    counts = shingle_counts(docs, text, tokens, sorted({w for _, g, _, w in grams if len(g)}))
    n = len(block.items)
    best = np.full(n, np.iinfo(np.int64).max)
    token, place, wide = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.ones(n, np.int64)
    for rows, g, at, width in grams:
        rarity = counts[np.searchsorted(tokens, g)]
        better = rarity < best[rows]
        best[rows[better]], token[rows[better]] = rarity[better], g[better]
        place[rows[better]], wide[rows[better]] = at, width
    order = np.argsort(token, kind="stable")
    return Block([block.items[i] for i in order], block.words[order], block.lengths[order],
                 token[order], place[order], wide[order])


def _matches(block: Block, mask: np.ndarray, unique: np.ndarray, h: np.ndarray, rows: np.ndarray, ends: np.ndarray):
    """(window, first word) of every occurrence; ends: for each row the index behind its last word."""
    for width in np.unique(block.widths):
        g, at = _grams(h, rows, int(width))
        hit = _known(g, mask, unique)
        low = np.searchsorted(block.tokens, g[hit], "left")
        many = np.searchsorted(block.tokens, g[hit], "right") - low
        at = at[hit]
        i = 0
        total = np.concatenate([[0], np.cumsum(many)])
        while i < len(hit):  # so many proposals at a time; one position's are never more than the block
            j = max(i + 1, int(np.searchsorted(total, total[i] + _PAIRS, "right")) - 1)
            n = many[i:j]
            w = np.repeat(low[i:j] - (total[i:j] - total[i]), n) + np.arange(total[j] - total[i])
            word = np.repeat(at[i:j], n)
            start = word - block.places[w]
            row = rows[word]
            ok = (start >= ends[row - 1] * (row > 0)) & (start + block.lengths[w] <= ends[row])
            w, start = w[ok], start[ok]
            for k in range(block.words.shape[1]):
                inside = k < block.lengths[w]
                same = ~inside
                same[inside] = h[start[inside] + k] == block.words[w[inside], k]
                w, start = w[same], start[same]
            yield w, start
            i = j


def _search(block: Block, text: str, spans: str, items: str):
    shared = block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        unique = np.unique(b.tokens)
        mask = _mask(unique)
        for batch in batches:
            counts, out_spans, out_items = [], [], []
            before = batch.column(spans).to_pylist() if spans in batch.schema.names else None
            names = batch.column(items).to_pylist() if items in batch.schema.names else None
            for first, data, offsets in words.slices(batch, text):
                h, rows, _, _ = words.hash_words(data, offsets, words.ALNUM)
                total = len(offsets) - 1
                bounds = np.searchsorted(rows, np.arange(total + 1))
                step = np.zeros(len(h) + 1, np.int64)
                found: dict[int, set] = {}
                for w, start in _matches(b, mask, unique, h, rows, bounds[1:]):
                    np.add.at(step, start, 1)
                    np.add.at(step, start + b.lengths[w], -1)
                    pairs = np.unique(rows[start] * len(b.items) + w)
                    for r, i in zip(pairs // len(b.items), pairs % len(b.items)):
                        found.setdefault(int(r), set()).add(b.items[i])
                inside = np.cumsum(step) > 0
                counts.extend(np.diff(bounds))
                for r in range(total):
                    if r in found or (before and before[first + r]):
                        own = inside[bounds[r]:bounds[r + 1]].copy()
                        for s in (before[first + r] if before else ()):
                            own[s["start"]:s["end"]] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                        out_spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[0::2], edge[1::2])])
                        out_items.append(sorted(found.get(r, set()) | set(names[first + r] if names else ())))
                    else:
                        out_spans.append([])
                        out_items.append([])
            keep = [n for n in batch.schema.names if n not in (spans, items, "__n_words")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], pa.array(np.asarray(counts, np.int64)),
                 pa.array(out_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(out_items, pa.list_(pa.string()))], [*keep, "__n_words", spans, items])

    return search


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The input with n_words, hit_spans (word ranges, end exclusive), n_hit and item_ids (strings, sorted)."""
    spark = docs.sparkSession
    wanted = saved(item_windows(items, item_id, item_text, window), "item-windows")
    blocks = max(1, -(-wanted.count() // block_windows))
    # hashes deal the pairs evenly, so a block stays close to its bound
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    span_type = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    out = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"))
    for k in range(blocks):
        block = build_block(dealt.filter(F.col("block") == k).select("item", "words").toPandas())
        shared = spark.sparkContext.broadcast(with_prefixes(block, docs, text))
        schema = StructType([*[f for f in out.schema.fields if f.name not in ("__n_words", "__spans", "__items")],
                             StructField("__n_words", LongType()), StructField("__spans", span_type),
                             StructField("__items", ArrayType(StringType()))])
        out = out.mapInArrow(_search(shared, "__text", "__spans", "__items"), schema)
        if k + 1 < blocks:
            out = saved(out, "contamination")
    own = ("n_words", "hit_spans", "item_ids", "n_hit")
    return out.select(
        *[F.col("__row")[c].alias(c) for c in docs.columns if c.lower() not in own],
        F.col("__n_words").alias("n_words"), F.col("__spans").alias("hit_spans"), F.col("__items").alias("item_ids"),
        F.aggregate("__spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that share no window with the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__text"))
    return contamination(whole, items, text="__text").filter("n_hit = 0").select("row.*")


def query(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, ws[p:p + 9] AS win FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(p) WHERE len(ws) > 0),
p AS (SELECT doc_id, p, ws, len(ws) AS n FROM d, unnest(range(1, len(ws) + 1)) AS u(p)),
s AS (SELECT DISTINCT len(win) AS n FROM w),
c AS (SELECT doc_id, p, s.n AS k, ws[p:p + s.n - 1] AS win FROM p, s WHERE p + s.n - 1 <= p.n),
h AS (SELECT c.doc_id, c.p, c.k, w.item_id FROM c JOIN w ON c.win = w.win),
n AS (SELECT doc_id, count(DISTINCT p + q) AS n_hit FROM (SELECT DISTINCT doc_id, p, k FROM h), unnest(range(0, k)) AS u(q) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
