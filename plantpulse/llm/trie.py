"""Prefix trie of conversations and its rollup by centroid decomposition.

Turns get their place by one range sort, so a conversation that holds a third of all rows is spread over tasks. The
prefix of a conversation is known by the exclusive-or of two 64-bit hashes of (place, role, text) over its turns, which
adds up over tasks; equal depth and equal hashes are one node.

The rollup (childless nodes and savings of every subtree) works on the parent-edge forest. The mass of a node, the
turns and ends of all members from its depth on, comes with the grouping that makes the nodes. In a component the nodes
with more than half of its mass are the path from the top to the centroid; the centroid's subtree is summed, the sum is
added to all nodes of that path, and the component falls into the rest above and one component per child of the
centroid, each of at most half the mass. Components beyond `LOCAL_NODES` nodes are split in rounds of Spark joins,
all at once; smaller ones are handed to one task each and finished there in the same way.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.llm.common import empty_if_null, saved, table, word_array
from plantpulse.llm.ranks import runs, sorted_rows, with_runs

# Components up to this many nodes are split within one task.
LOCAL_NODES = 4096
# Nodes of one conversation ask for their ancestors in stretches of this depth.
STRETCH = 1024
# Nodes of at least 1/HOT of all rows are few enough (at most HOT) to be broadcast; others have few members.
HOT = 10_000


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as two content hashes and a number of words: conv, turn, a, b, words. Null role or text is empty; rows
    without a conversation take no part."""
    said = [empty_if_null(role), empty_if_null(text)]
    return df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.xxhash64(*said).alias("a"), F.xxhash64(F.lit(1), *said).alias("b"),
        F.size(word_array(said[1])).cast("bigint").alias("words"))


def placed(rows: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Rebuilt conversations: the first `head` (at most `most`) turns of conversation `base`, then the own turns after
    the first `head`. Both are expressions over `conv`. Returns conv, part, pos (from 1), x, y (hashes of place and content), words, and
    rows of part -2 and place 0 that stand for the conversations themselves.

    Turns are ordered by `turn`, null first; ties go by the content hashes.
    """
    rows = sorted_rows(rows, ["conv", "turn", "a", "b"], "trie-turns")
    table = runs(rows, ["conv"])
    place = F.col("before") + F.col("at") - F.col("first") + 1
    convs = table.groupBy("conv").agg(F.max("n_group").alias("n")).withColumns({"base": base, "head": head})
    firsts = (with_runs(rows, table, ["conv"]).withColumn("pos", place).filter(F.col("pos") <= most)
              .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("firsts")))
    convs = convs.join(firsts.select(F.col("conv").alias("base"), "firsts"), "base", "left")
    taken = F.coalesce(F.slice("firsts", F.lit(1), F.col("head").cast("int")), F.array().cast(firsts.schema["firsts"].dataType))
    convs = saved(convs.select("conv", "head", taken.alias("taken")), "trie-heads")
    table = table.join(convs.select("conv", "head", F.size("taken").alias("lead")), "conv")
    own = with_runs(rows, table, ["conv"]).withColumn("own", place).filter("own > head").select(
        "conv", "part", (F.col("own") - F.col("head") + F.col("lead")).alias("pos"), "a", "b", "words")
    lead = convs.select("conv", F.lit(-1).cast("bigint").alias("part"), F.explode("taken").alias("t")).select("conv", "part", "t.*")
    both = own.unionByName(lead).select(
        "conv", "part", "pos", F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64(F.lit(1), "pos", "a", "b").alias("y"), "words")
    zero = F.lit(0).cast("bigint")
    start = convs.select("conv", F.lit(-2).cast("bigint").alias("part"), zero.alias("pos"), zero.alias("x"), zero.alias("y"), zero.alias("words"))
    return saved(both.unionByName(start), "trie-places")


def prefixes(rows: DataFrame) -> DataFrame:
    """rows of `placed` with the hashes of their whole prefix and the length of the conversation: conv, pos, x, y, words, length."""
    each = rows.groupBy("conv", "part").agg(F.bit_xor("x").alias("rx"), F.bit_xor("y").alias("ry"), F.max("pos").alias("last"))
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("conv", "part", F.coalesce(F.bit_xor("rx").over(earlier), F.lit(0)).alias("ox"),
                       F.coalesce(F.bit_xor("ry").over(earlier), F.lit(0)).alias("oy"), F.max("last").over(whole).alias("length"))
    so_far = Window.partitionBy("conv", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"x": F.bit_xor("x").over(so_far), "y": F.bit_xor("y").over(so_far)}).join(each, ["conv", "part"])
    return saved(out.select("conv", "pos", F.col("x").bitwiseXOR(F.col("ox")).alias("x"), F.col("y").bitwiseXOR(F.col("oy")).alias("y"),
                            "words", "length"), "trie-prefixes")


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, seen) of the rows of `prefixes`. A node is (node, pos), its least member and its depth, with n, words, mass
    (turns and ends of its members from its depth on); seen says to which node each (conv, pos) belongs."""
    made = saved(rows.groupBy("pos", "x", "y").agg(
        F.min("conv").alias("node"), F.count("*").alias("n"), F.max("words").alias("words"),
        F.sum(F.col("length") - F.col("pos") + 1).alias("mass")), "trie-nodes")
    total = made.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(STRETCH, total // HOT)
    key = ["pos", "x", "y"]
    first = rows.join(F.broadcast(made.filter(hot).select(*key, F.col("node").alias("hot"))), key, "left")
    first = saved(first.select("conv", *key, "length", "hot"), "trie-hot")
    rest = first.filter("hot IS NULL").join(made.filter(~hot).select(*key, "node"), key)
    seen = first.filter("hot IS NOT NULL").select("conv", "pos", F.col("hot").alias("node"), "length").unionByName(
        rest.select("conv", "pos", "node", "length"))
    return made.drop("x", "y"), saved(seen, "trie-seen")


def forest_of(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes with `parent` (its least member; null at the root) and `kids`, the number of children."""
    up = seen.select(F.col("conv").alias("node"), (F.col("pos") + 1).alias("pos"), F.col("node").alias("parent"))
    nodes = saved(nodes.join(up, ["node", "pos"], "left"), "trie-parents")
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("kids"))
    return saved(nodes.join(kids, ["node", "pos"], "left").fillna(0, ["kids"]), "trie-forest")


def rollup(forest: DataFrame, seen: DataFrame, values: list[str], local_nodes: int = LOCAL_NODES) -> DataFrame:
    """Sums of the values over every node's subtree: node, pos and the values.

    forest: node, pos, parent, mass, and the values. Every round at least halves the mass of every component that is
    left, so there are as many rounds as the mass of the whole has binary digits, at most.
    """
    state = forest.select("node", "pos", "parent", "mass", *values, *[F.lit(0).cast("bigint").alias(f"add_{v}") for v in values],
                          F.struct(F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("pos")).alias("comp"))
    adds, small, done = [f"add_{v}" for v in values], [], []
    ways = seen.select(F.col("conv").alias("node"), F.col("pos").alias("at"), F.col("node").alias("on"))
    while True:
        sizes = saved(state.groupBy("comp").agg(F.count("*").alias("size"), F.max("mass").alias("total")), "trie-sizes")
        here = state.join(sizes, "comp")
        small.append(here.filter(F.col("size") <= local_nodes).drop("size", "total"))
        if not sizes.filter(F.col("size") > local_nodes).limit(1).count():
            break
        here = saved(here.filter(F.col("size") > local_nodes), "trie-large")
        onpath = F.col("mass") * 2 > F.col("total")
        centroid = here.filter(onpath).groupBy("comp").agg(
            F.max_by(F.struct(F.col("node").alias("c"), F.col("pos").alias("cpos"), F.col("mass").alias("cmass")), "pos").alias("m"))
        here = here.join(centroid.select("comp", "m.*"), "comp").withColumn("stretch", F.expr(f"pos div {STRETCH}"))
        # which nodes lie below the centroid, and under which child: the prefix of their own conversation says
        asked = here.filter(F.col("pos") >= F.col("cpos")).select("comp", "node", "stretch", "c", "cpos").distinct()
        answer = (asked.withColumn("at", F.explode(F.array(F.col("cpos"), F.col("cpos") + 1)))
                  .join(ways, ["node", "at"]).groupBy("comp", "node", "stretch")
                  .agg(F.max(F.when(F.col("at") == F.col("cpos"), F.col("on") == F.col("c"))).alias("below"),
                       F.max(F.when(F.col("at") == F.col("cpos") + 1, F.col("on"))).alias("child")))
        here = here.join(answer, ["comp", "node", "stretch"], "left")
        below = F.coalesce("below", F.lit(False)) & (F.col("pos") >= F.col("cpos"))
        here = saved(here.withColumn("below", below), "trie-split")
        sums = here.filter("below").groupBy("comp").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
        here = here.join(sums, "comp")
        is_c = F.col("below") & (F.col("pos") == F.col("cpos"))
        above = ~F.col("below") & onpath
        here = here.withColumns({
            **{f"add_{v}": F.when(is_c | above, F.col(f"add_{v}") + F.col(f"sum_{v}")).otherwise(F.col(f"add_{v}")) for v in values},
            "mass": F.when(above, F.col("mass") - F.col("cmass")).otherwise(F.col("mass")),
            "comp": F.when(F.col("below"), F.struct(F.col("child").alias("node"), (F.col("cpos") + 1).alias("pos"))).otherwise(F.col("comp")),
            "ready": is_c})
        here = saved(here, "trie-round")
        done.append(here.filter("ready").select("node", "pos", *[F.col(f"add_{v}").alias(v) for v in values]))
        state = here.filter("NOT ready").select("node", "pos", "parent", "mass", *values, *adds, "comp")
    left = small[0]
    for other in small[1:]:
        left = left.unionByName(other)
    left = left.repartition("comp").sortWithinPartitions("comp", "pos", "node")
    out = left.mapInArrow(_finish(values), forest.select("node", "pos", *values).schema)
    for other in done:
        out = out.unionByName(other)
    return out


def _finish(values: list[str]):
    def finish(batches):
        for group in _groups(batches, ["comp"]):
            at = {(n, p): i for i, (n, p) in enumerate(zip(group["node"], group["pos"]))}
            # the top's parent lies outside its component; nodes come by depth, so parents stand before their children
            parents = [-1 if up is None else at.get((up, p - 1), -1) for up, p in zip(group["parent"], group["pos"])]
            sums = decomposed(parents, group["mass"], [group[v] for v in values], [group[f"add_{v}"] for v in values])
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(group["node"], pa.int64()), "pos": pa.array(group["pos"], pa.int64()),
                **{v: pa.array(s, pa.int64()) for v, s in zip(values, sums)}})
    return finish


def decomposed(parents: list[int], mass: list[int], values: list[list[int]], adds: list[list[int]]) -> list[list[int]]:
    """Subtree sums of one tree by centroids: `adds` plus the sums of `values`. Parents stand before their children."""
    kids: list[set[int]] = [set() for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            kids[p].add(i)
    mass, adds = list(mass), [list(a) for a in adds]
    tops = [i for i, p in enumerate(parents) if p < 0]
    while tops:
        top = tops.pop()
        path, c = [], top
        while (heavy := next((k for k in kids[c] if 2 * mass[k] > mass[top]), None)) is not None:
            path.append(c)
            c = heavy
        below, seen = [c], 0
        while seen < len(below):
            below.extend(kids[below[seen]])
            seen += 1
        for value, add in zip(values, adds):
            total = sum(value[i] for i in below)
            for i in (*path, c):
                add[i] += total
        for i in path:
            mass[i] -= mass[c]
        tops.extend(kids[c])
        if path:
            kids[path[-1]].remove(c)
            tops.append(top)
    return adds


def _groups(batches, keys: list[str]):
    """Rows of sorted Arrow batches, as one dictionary of lists per group; a group may span batches."""
    mark, held = None, None
    for batch in batches:
        rows = batch.to_pydict()
        names = list(rows)
        marks = list(zip(*[map(str, rows[k]) for k in keys]))
        for key, index in groupby(range(batch.num_rows), key=marks.__getitem__):
            index = list(index)
            if held is not None and key == mark:
                for n in names:
                    held[n].extend(rows[n][index[0]:index[-1] + 1])
                continue
            if held is not None:
                yield held
            mark, held = key, {n: rows[n][index[0]:index[-1] + 1] for n in names}
    if held is not None:
        yield held


def ends_digest(seen: DataFrame) -> DataFrame:
    """(node, pos, ends_sha256) of the nodes at which conversations end. A digest of one list is sequential by its
    definition: the ids of a node stream through one task in order and are never held."""
    ends = seen.filter("pos = length").select("node", "pos", "conv")
    ends = ends.repartition("node", "pos").sortWithinPartitions("node", "pos", "conv")

    def digest(batches):
        mark, state = None, None
        for batch in batches:
            out = []
            rows = zip(*[batch.column(i).to_pylist() for i in range(3)])
            for key, members in groupby(rows, key=lambda r: r[:2]):
                ids = ",".join(str(m[2]) for m in members).encode()
                if key == mark:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    out.append((*mark, state.hexdigest()))
                mark, state = key, hashlib.sha256(ids)
            if out:
                yield _digest_rows(out)
        if state is not None:
            yield _digest_rows([(*mark, state.hexdigest())])

    return ends.mapInArrow(digest, "node bigint, pos bigint, ends_sha256 string")


def _digest_rows(rows):
    node, pos, ends = zip(*rows)
    return pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "pos": pa.array(pos, pa.int64()), "ends_sha256": pa.array(ends, pa.string())})


def trie(rows: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """All nodes of the trie over rows of `placed`: conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    The root has no text; without any conversation there is no root. Repeated turns are turns of their own; very long
    texts count like any other, as only their hashes and their number of words travel. Columns of the input other than
    those named take no part, so their names cannot clash.
    """
    nodes, seen = nodes_of(prefixes(rows))
    forest = forest_of(nodes, seen)
    weighed = forest.select("node", "pos", "parent", "mass", (F.col("kids") == 0).cast("bigint").alias("n_leaves"),
                            ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"))
    sums = rollup(weighed, seen, ["n_leaves", "saved_tokens"], local_nodes)
    out = forest.join(sums, ["node", "pos"]).join(ends_digest(seen), ["node", "pos"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("node").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"),
                      F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def query(spark, folder: str) -> DataFrame:
    """The trie of all conversations, each rebuilt upon the first turns of the one that leads its twenty."""
    rows = turns(table(spark, folder, "conversations"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return trie(placed(rows, F.col("conv") - F.col("conv") % 20, head, 3))


# Start and polynomial of CRC-32; the result's two last bits are those of the register, flipped.
_HEAD = """(3 - list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
  lambda x: list_transform(range(8), lambda k: ((ascii(x) >> k::INTEGER) & 1)::UBIGINT)))),
  lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) % 4)::BIGINT"""
ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT conv_id, h, (SELECT count(*) FROM t WHERE t.conv_id = c.conv_id - c.conv_id % 20 AND p <= h) AS lead FROM c),
r AS (SELECT b.conv_id, t.p, role, text FROM b JOIN t ON t.conv_id = b.conv_id - b.conv_id % 20 AND t.p <= h
  UNION ALL SELECT b.conv_id, t.p - h + lead, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.p > h
  UNION ALL SELECT conv_id, 0, '', '' FROM b),
q AS (SELECT conv_id, p AS depth, list(sha256(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY p) AS seq,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, max(p) OVER (PARTITION BY conv_id) AS length FROM r),
n AS (SELECT depth, sha256(array_to_string(seq, '')) AS key, sha256(array_to_string(seq[:-2], '')) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
    max(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends FROM q GROUP BY depth, seq),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.up = n.key) AS n_children
  FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.key = n.up),
s AS (SELECT q.conv_id AS of, k.depth, k.conv_id, k.n_convs, k.n_children, k.words, k.key FROM q JOIN k ON k.conv_id = q.conv_id AND k.depth = q.depth),
w AS (SELECT q.depth, sha256(array_to_string(q.seq, '')) AS key, count(*) FILTER (s.n_children = 0) AS n_leaves, sum((s.n_convs - 1) * s.words) AS saved_tokens
  FROM s JOIN q ON q.conv_id = s.of AND q.depth <= s.depth GROUP BY 1, 2)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, w.n_leaves, w.saved_tokens::BIGINT AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN w ON k.depth = w.depth AND k.key = w.key
"""
