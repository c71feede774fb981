"""Near duplicates by an exact metric-space join under the Jaccard distance of word shingles.

Two sets are linked when their distance d = 1 - |intersection| / |union| is at most `radius`.

1. Equal sets become one node (64-bit fingerprint of the set).
2. Pivots. Shingles are put in one order for the whole corpus, rare ones first (popularity counted over all texts in
   a sketch of fixed size). Linked sets share at least k shingles among the first n - ceil((1 - radius) n) + k of
   each, here k = n / 16. A node of which fewer leading shingles occur elsewhere has no links. The least node that
   leads with a shingle is a pivot, and all nodes that lead with it belong to its region. So every linked pair lies
   in k regions, and a group of thousands is one star, not all its pairs. A node leaves the regions that together
   stand for less than half of the k shingles: one region of the pair remains whatever the other node leaves.
3. Regions. With the exact distance of every member to the pivot, members within the radius are linked and need no
   comparison among themselves. The triangle inequality leaves only pairs whose distances to the pivot differ by at
   most the radius: rings around the pivot, with the members of the next ring replicated into the boundary window,
   are joined recursively with pivots of their own.
4. A region too large for one task is first cut by Spark: several pivots make Voronoi regions, a member is replicated
   to every region whose pivot is at most 2 x radius farther than its nearest one, and the parts go round again.
5. Links become connected components by star joins.

No pair of equal texts is ever made, no region is sampled or capped. Sets of shingles are shuffled only for nodes
that share a leading shingle with another node.

Defined cases: a null or empty text has an empty set and is linked with nothing. A text shorter than a shingle is one
shingle. Rows with equal texts are one node; a repeated row gets the same answer twice. A null id never names a
component; a component without any other id has a null one, except for empty sets, which keep their own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from plantpulse.llm import words
from plantpulse.llm.common import maybe_in, saved, small_batches
from plantpulse.llm.graph import components

WIDTH = 5
RADIUS = 0.25
# Counters of the popularity sketch: 16 MB in a task, 8 MB as levels when broadcast, whatever the corpus.
SKETCH_BITS = 22
_BLOCKS = 64
# Bytes of text that a task turns into shingles at once.
SLICE_BYTES = 256 << 10
# Bits of the filters of wanted nodes and shingles: 4 MB when broadcast. A full filter only saves nothing.
FILTER_BITS = 25
# Leading shingles beyond the first difference, as a part of the set.
SPARE = 16
# A region with more members or shingles than this is cut by Spark before a task joins it.
REGION_ROWS, REGION_SHINGLES = 4096, 4 << 20
# Pivots a large region is cut by in one round.
PIVOTS = 4


def _shingle_slices(batch: pa.RecordBatch, text: str, width: int):
    for first, data, offsets in words.slices(batch, text, SLICE_BYTES):
        h, rows, _, _ = words.hash_words(data, offsets, words.SPACED)
        yield first, *words.shingles(h, rows, len(offsets) - 1, width)


def popularity(docs: DataFrame, text: str, width: int = WIDTH) -> np.ndarray:
    """Level of each counter: 64 x log2 of how many sets hold a shingle that falls on it."""
    size, part = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // _BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for _, h, _ in _shingle_slices(batch, "text", width):
                np.add.at(total, h & np.uint64(size - 1), 1)
        yield from _blocks(total)

    def _blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counters byte by byte, as most need one within a task."""
        place = 0
        while total.any():
            used = [k for k in range(_BLOCKS) if total[k * part:(k + 1) * part].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([place] * len(used), pa.int32()),
                 pa.array([(total[k * part:(k + 1) * part] & 255).astype(np.uint8).tobytes() for k in used], pa.binary())],
                ["block", "place", "counts"])
            total >>= 8
            place += 8

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, p, x in zip(batch.column("block").to_pylist(), batch.column("place").to_pylist(), batch.column("counts")):
                total.setdefault(k, np.zeros(part, np.int64))[:] += np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64) << p
        for k, sums in total.items():
            levels = np.round(64 * np.log2(sums + 1)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([levels.tobytes()], pa.binary())],
                                             ["block", "levels"])

    # tasks turn the counters into levels, so the driver holds 8 MB and no counters
    blocks = docs.select(F.col(text).alias("text")).mapInArrow(count, "block int, place int, counts binary").repartition(
        "block").mapInArrow(add, "block int, levels binary")
    out = np.zeros(size, np.uint16)
    for row in blocks.collect():  # the fixed number of blocks
        out[row.block * part:(row.block + 1) * part] = np.frombuffer(row.levels, np.uint16)
    return out


def _nodes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each set, from its distinct shingles and their number."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    return words.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).astype(np.int64)


def _least_overlap(n, radius: float):
    """What a set of n shares at least with a linked one, and so the least size of that one."""
    return np.ceil((1 - radius) * n - 1e-9).astype(np.int64)


def _spare(n):
    return -(-n // SPARE)


def _prefix_length(n: np.ndarray, radius: float) -> np.ndarray:
    return np.minimum(n, n - _least_overlap(n, radius) + _spare(n))


def _least_shared(n: np.ndarray, radius: float) -> np.ndarray:
    """Leading shingles that a set of n shares at least with any linked one, however small that is."""
    return _spare(_least_overlap(n, radius))


def leading(docs: DataFrame, doc_id: str, text: str, levels: np.ndarray, width: int, radius: float) -> DataFrame:
    """doc_id, n_shingles, node, how many leading shingles a linked set shares at least, and the leading shingles of
    every row; node is null for an empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("n_shingles", LongType()),
                         StructField("node", LongType()), StructField("least", LongType()),
                         StructField("lead", ArrayType(LongType()))])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        mask = np.uint64(len(level) - 1)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, h, bounds in _shingle_slices(batch, "text", width):
                n = np.diff(bounds)
                keys = (level[h & mask].astype(np.uint64) << np.uint64(51)) | (h >> np.uint64(13))
                length = np.where(n > 0, _prefix_length(n, radius), 0)
                ends = np.concatenate([[0], np.cumsum(length)])
                out = np.zeros(ends[-1], np.uint64)
                for i in range(len(n)):
                    part = keys[bounds[i]:bounds[i + 1]]
                    part.sort()
                    out[ends[i]:ends[i + 1]] = part[:length[i]]
                nodes = pa.array(_nodes(h, bounds), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n.astype(np.int64)), nodes,
                     pa.array(_least_shared(n, radius)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.astype(np.int64)))],
                    ["doc_id", "n_shingles", "node", "least", "lead"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lead, schema)


def _filter_bits(nodes: DataFrame, column: str) -> np.ndarray:
    """A bit for each value of the column; of fixed size, so it may be collected and broadcast."""
    bit = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    rows = nodes.select(bit.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = np.zeros((1 << FILTER_BITS) // 8 + 8192, np.uint8)
    for r in rows:
        # buckets count from 1 for x > 0, and x = 0 lies in bucket 0; positions are within the bucket
        out[r.bucket * 4096:(r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    x = values & np.int64((1 << FILTER_BITS) - 1)
    bucket = np.where(x > 0, 1 + (x - 1) // 32768, 0)
    place = np.where(x > 0, (x - 1) % 32768, 0)
    return (bits[bucket * 4096 + place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1


def _shared_shingles(rows: DataFrame) -> DataFrame:
    """Shingles that lead more than one node, with the least such node."""
    return saved(rows.groupBy("shingle").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
                 .filter("pivot <> last").select("shingle", "pivot"), "shared-shingles")


def _thinned(lead: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, least, shingle) of leading shingles that may be among the groups, for nodes that may have `least` of them.

    Spares the join most rows: what the filter passes is never less than what the groups hold.
    """
    shared = lead.sparkSession.sparkContext.broadcast(_filter_bits(groups, "shingle"))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            rows = [i for i, x in enumerate(nodes) if not (x in seen or seen.add(x))]  # copies in one task count once
            batch = batch.take(pa.array(rows, pa.int64()))
            lists = batch.column("lead")
            keys, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            ok = _passes(bits, keys)
            passed = np.concatenate([[0], np.cumsum(ok)])
            ends = np.concatenate([[0], np.cumsum(n)])
            ok &= np.repeat(passed[ends[1:]] - passed[ends[:-1]] >= batch.column("least").to_numpy(zero_copy_only=False), n)
            columns = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)[ok] for c in ("node", "least")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(keys[ok])], ["node", "least", "shingle"])

    return lead.select("node", "least", "lead").mapInArrow(thin, "node bigint, least bigint, shingle bigint")


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the given nodes and some more, without a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter_bits(nodes, "node"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            yield batch.filter(pa.array(_passes(bits, batch.column("node").to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(keep, rows.schema)


def stars(lead: DataFrame) -> DataFrame:
    """(node, pivot): each node with the pivots of the regions it belongs to, pivots themselves left out."""
    full = lead.filter("n_shingles > 0").select("node", "least", "lead")
    groups = _shared_shingles(full.select("node", F.explode("lead").alias("shingle")))
    # copies in different tasks may count twice, which only keeps more nodes
    seen = _thinned(full, groups).join(groups.select("shingle"), "shingle").groupBy("node", "least").agg(
        F.count("*").alias("n"))
    able = saved(seen.filter("n >= least").select("node"), "able")
    full = saved(_only(full, able).dropDuplicates(["node"]), "able-leading")
    groups = _shared_shingles(full.select("node", F.explode("lead").alias("shingle")))
    pairs = full.select("node", "least", F.explode("lead").alias("shingle")).join(groups, "shingle").groupBy(
        "node", "least", "pivot").agg(F.count("*").alias("n"))
    by_support = Window.partitionBy("node").orderBy("n", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node")  # a node has no more pivots than leading shingles
    pairs = pairs.withColumns({"low": F.sum("n").over(by_support), "all": F.sum("n").over(whole)})
    return saved(pairs.filter((F.col("all") >= F.col("least")) & (2 * F.col("low") >= F.col("least"))
                              & (F.col("node") != F.col("pivot"))).select("node", "pivot"), "stars")


def sets_of(docs: DataFrame, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, and of some more; one row per node."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted, "node"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            for _, h, bounds in _shingle_slices(batch, "text", width):
                nodes = _nodes(h, bounds)
                rows = [i for i in np.flatnonzero(_passes(bits, nodes) & (np.diff(bounds) > 0)) if nodes[i] not in seen]
                rows = list({int(nodes[i]): i for i in rows}.values())  # copies in one task are sent once
                seen.update(int(nodes[i]) for i in rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[rows]), pa.array([h[bounds[i]:bounds[i + 1]].astype(np.int64) for i in rows],
                                                     pa.list_(pa.int64()))], ["node", "shingles"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(find, "node bigint, shingles array<bigint>")
    return rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


class _Forest:
    """Components within one region."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        new = others[self.of[others] != self.of[a]]
        for b in new:
            if self.of[b] != self.of[a]:
                self.links.append((a, int(b)))
                self.of[self.of == self.of[b]] = self.of[a]


def join_region(keys: np.ndarray, bounds: np.ndarray, outer: np.ndarray, radius: float) -> list[tuple[int, int]]:
    """Links that connect the sets of one region as all its links would.

    Set i is keys[bounds[i]:bounds[i + 1]]. Pairs of two sets that are not `outer` are joined elsewhere.
    """
    _, ids = np.unique(keys, return_inverse=True)
    size = np.diff(bounds)
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    forest = _Forest(len(size))

    def distances(pivot: int, others: np.ndarray) -> np.ndarray:
        own = ids[bounds[pivot]:bounds[pivot + 1]]
        mark[own] = True
        n = size[others]
        at = np.repeat(bounds[others] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.add.reduceat(mark[ids[at]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        mark[own] = False
        return 1 - common / (n + size[pivot] - common)

    todo = [(np.flatnonzero(outer), np.flatnonzero(~outer))]
    while todo:
        out, inner = todo.pop()
        if len(out) + len(inner) < 2 or not len(out) or len(np.unique(forest.of[np.concatenate([out, inner])])) == 1:
            continue  # what is connected needs no more comparisons
        pivot, out = int(out[0]), out[1:]
        others = np.concatenate([out, inner])
        d = distances(pivot, others)
        forest.join(pivot, others[d <= radius + 1e-12])
        d_out, d_in = d[:len(out)], d[len(out):]
        ring = np.floor(np.maximum(d_out - 1e-9, 0) / radius).astype(int)
        for k in np.unique(ring):
            own = ring == k
            low, high = d_out[own].min() - radius - 1e-9, d_out[own].max() + radius + 1e-9
            near = np.concatenate([inner[(d_in >= low) & (d_in <= high)], out[(ring < k) & (d_out >= low)]])
            todo.append((out[own], near))
    return forest.links


def _join_small(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """Links of all regions in a stream of rows sorted by region."""
    rest: list[pa.RecordBatch] = []

    def solve(region_rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        nodes = region_rows["node"].to_numpy()
        lists = region_rows["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        keys = lists.flatten().to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        regions = region_rows["region"].to_numpy()
        outer = region_rows["outer"].to_numpy(zero_copy_only=False).astype(bool)
        cut = np.flatnonzero(np.concatenate([[True], regions[1:] != regions[:-1], [True]]))
        left, right = [], []
        for low, high in zip(cut[:-1], cut[1:]):
            links = join_region(keys[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low], outer[low:high], radius)
            left += [nodes[low + a] for a, _ in links]
            right += [nodes[low + b] for _, b in links]
        return np.array(left, np.int64), np.array(right, np.int64)

    def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows and sum(len(b) for b in rows):
            a, b = solve(pa.Table.from_batches(rows))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        regions = batch.column("region").to_numpy()
        last = len(regions) - int(np.argmax((regions != regions[-1])[::-1])) if regions[0] != regions[-1] else 0
        if last:  # the last region of a batch may go on in the next one
            yield from out([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
        elif rest and rest[-1].column("region")[0].as_py() != regions[0]:
            yield from out(rest)
            rest = [batch]
        else:
            rest.append(batch)
    yield from out(rest)


def _cut(members: DataFrame, sets: DataFrame, round_no: int, radius: float, pivots: int) -> tuple[DataFrame, DataFrame]:
    """One round for large regions: (links to the pivots, members of the smaller regions).

    Every outer member stays outer in one region, that of its nearest pivot; members within the radius of the pivot
    are connected and meet only those that are not.
    """
    bucket = F.pmod(F.xxhash64(F.lit(round_no), "node"), F.lit(pivots))
    chosen = members.filter("outer").groupBy("region", bucket.alias("k")).agg(F.min("node").alias("node"))
    seeds = chosen.join(sets, "node").groupBy("region").agg(F.sort_array(F.collect_list(
        F.struct("node", "shingles"))).alias("seeds"))  # `pivots` sets at most
    rows = members.join(sets, "node").join(seeds, "region")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, node, outer, at, dist = [], [], [], [], []
            for i in range(len(batch)):
                own = batch.column("shingles")[i].values.to_numpy()
                seeds_here = batch.column("seeds")[i].values
                for j in range(len(seeds_here)):
                    pivot = seeds_here.field("shingles")[j].values.to_numpy()
                    common = len(np.intersect1d(own, pivot, assume_unique=True))
                    region.append(batch.column("region")[i].as_py())
                    node.append(batch.column("node")[i].as_py())
                    outer.append(batch.column("outer")[i].as_py())
                    at.append(seeds_here.field("node")[j].as_py())
                    dist.append(1 - common / (len(own) + len(pivot) - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array(region, pa.int64()), pa.array(node, pa.int64()), pa.array(outer, pa.bool_()),
                 pa.array(at, pa.int64()), pa.array(dist, pa.float64())], ["region", "node", "outer", "pivot", "d"])

    far = saved(rows.select("region", "node", "outer", "shingles", "seeds").mapInArrow(
        measure, "region bigint, node bigint, outer boolean, pivot bigint, d double"), "pivot-distances")
    links = far.filter((F.col("d") <= radius + 1e-12) & (F.col("node") != F.col("pivot"))).select(
        F.col("node").alias("a"), F.col("pivot").alias("b"))
    done = far.filter("node = pivot").select("region", "node").distinct()  # pivots have met all members
    home = far.groupBy("region", "node").agg(F.min(F.struct("d", "pivot")).alias("h"))
    rows = far.join(home, ["region", "node"]).join(done, ["region", "node"], "left_anti")
    at_home, ball = F.col("pivot") == F.col("h.pivot"), F.col("d") <= radius + 1e-12
    window = F.col("d") <= F.col("h.d") + 2 * radius + 1e-9
    # an outer member visits, as inner, only the regions of smaller pivots: each pair of outer members meets once
    visits = window & (~F.col("outer") | (F.col("pivot") < F.col("h.pivot")))
    out_here = F.col("outer") & at_home
    rows = rows.filter(out_here | visits).select("region", "node", "pivot", "d", out_here.alias("outer"), ball.alias("ball"))
    # outside the ball: all against those; inside: only against inner members outside
    shell = rows.withColumn("outer", F.col("outer") & ~F.col("ball")).withColumn("part", F.lit(0))
    inside = rows.filter((F.col("ball") & F.col("outer")) | (~F.col("ball") & ~F.col("outer") & (
        F.col("d") <= 2 * radius + 1e-9))).withColumn("part", F.lit(1))
    parts = shell.unionByName(inside).withColumn(
        "next", F.xxhash64(F.lit(round_no), "region", "pivot", "part"))
    bounds = parts.filter("outer").groupBy("next").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    kept = parts.join(bounds, "next").filter(
        F.col("outer") | F.col("d").between(F.col("low") - radius - 1e-9, F.col("high") + radius + 1e-9))
    return links, kept.select(F.col("next").alias("region"), "node", "outer")


def region_links(star: DataFrame, sets: DataFrame, sizes: DataFrame, radius: float = RADIUS, most_rows: int = REGION_ROWS,
                 most_shingles: int = REGION_SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) that connect what the pairs within `radius` connect; sizes: (node, n) of every node in a star.

    Sets are shuffled to their nodes once and go on from there; they are only written if large regions need them again.
    """
    pivot_rows = star.select(F.col("pivot").alias("region"), F.col("pivot").alias("node")).distinct()
    members = saved(star.select(F.col("pivot").alias("region"), "node").unionByName(pivot_rows).withColumn(
        "outer", F.lit(True)), "regions")
    links, round_no = [], 0
    while True:
        weight = members.join(sizes, "node").groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
        is_large = (F.col("rows") > most_rows) | (F.col("shingles") > most_shingles)
        large = saved(weight.filter(is_large & (F.col("rows") > 2)).select("region"), "large-regions")
        done = large.isEmpty()
        if not done and not round_no:
            sets = saved(sets, "sets")
        small = members if done else members.join(large, "region", "left_anti")
        rows = small.join(sets, "node").select("region", "node", "outer", "shingles")
        rows = rows.repartition("region").sortWithinPartitions("region")
        links.append(saved(rows.mapInArrow(lambda b: _join_small(b, radius), "a bigint, b bigint"), "links"))
        if done:
            break
        found, members = _cut(members.join(large, "region", "left_semi"), sets, round_no, radius, pivots)
        links.append(found)
        members = saved(members, "regions")
        round_no += 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                    radius: float = RADIUS, **limits) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of the component) of every row."""
    with small_batches(docs.sparkSession):  # every step that hands rows to Python ends in here
        lead = saved(leading(docs, doc_id, text, popularity(docs, text, width), width, radius), "leading")
        star = stars(lead)
        wanted = star.select("node").unionByName(star.select(F.col("pivot").alias("node"))).distinct()
        sizes = saved(lead.filter("node IS NOT NULL").select("node", "n_shingles").join(wanted, "node", "left_semi").groupBy(
            "node").agg(F.first("n_shingles").alias("n")), "wanted")
        sets = sets_of(docs, text, sizes.select("node"), width)
        roots = components(region_links(star, sets, sizes, radius, **limits))
    nodes = lead.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least")).join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("node", "component_id")
    return lead.select("doc_id", "n_shingles", "node").join(named, "node", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least id; a repeated row stays once.

    A document is known by its id and its text, so rows of one id with unlike texts are documents of their own. Those
    without an id come last, in the order of their texts' hashes.
    """
    known = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"),
                     F.col("text").isNull().alias("no_text"), F.xxhash64("text").alias("a"), F.hash(F.lit(7), "text").alias("b"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("__text"), known.alias("__id"))
    found = saved(near_duplicates(own, "__id", "__text").select("doc_id", "component_id"), "components")
    # a document that is alone in its component stays where it is; only the others' rows are moved to their verdicts
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    several = saved(found.join(several, "component_id", "left_semi").distinct().select(
        F.col("doc_id").alias("__id"), F.col("component_id").alias("least"), F.xxhash64("doc_id").alias("__hash")), "several")
    marked = maybe_in(own.withColumn("__hash", F.xxhash64("__id")), "__hash", several)
    asked = marked.filter("__maybe").select("__id", "row").join(several.select("__id", "least"), "__id", "left")
    kept = asked.filter(F.col("least").isNull() | (F.col("least") == F.col("__id"))).dropDuplicates(["__id"])
    return marked.filter(~F.col("__maybe")).select("row.*").unionByName(kept.select("row.*"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
