"""Merkle manifest and prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from plantpulse.llm import merkle, trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([sha("".join(low[i:i + 3])) for i in range(0, len(low), 3)])
    return out


def steps(tree, i):
    """(before, after) of leaf i, from the leaf up."""
    found = []
    for level in tree[:-1]:
        run = i // 3 * 3
        found.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
        i //= 3
    return found


def brute_manifest(rows):
    """rows (key, group, leaf) -> list of (key, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((key, leaf))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf for _, leaf in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    return [(key, leaf, trees[g][-1][0], top[-1][0], steps(trees[g], i) + steps(top, j))
            for j, g in enumerate(order) for i, (key, leaf) in enumerate(groups[g])]


def manifest_rows(df):
    found = merkle.manifest(df, "doc_id", "source", merkle.leaf_digest([F.col("doc_id"), F.col("text")]))
    return [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in found.collect()]


def leaf_of(doc_id, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, text)))


def check_manifest(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, g string, h int, path string, rank int")
    want = brute_manifest([(r[0], r[1], leaf_of(r[0], r[2])) for r in rows])
    assert sorted(manifest_rows(df), key=repr) == sorted(want, key=repr)


def test_manifest_nulls_ties_and_clashing_names(spark):
    extra = ("x", 1, "p", 2)
    rows = [(i, random.Random(i).choice(["a", "b", None, "ä"]), f"t{i}\n" * (i % 5), *extra) for i in range(60)]
    rows += [(7, "a", "again", *extra)] * 3 + [(None, None, None, *extra)] * 2 + [(99, "alone", "", *extra), (100, "long", "x" * 300_000, *extra)]
    check_manifest(spark, rows)


def test_manifest_passes_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "_SIZE", 9)
    rows = [(i, f"s{i % 10}" if i % 3 else "hot", f"text {i}", "x", 1, "p", 2) for i in range(60)]
    check_manifest(spark, rows)


def test_manifest_of_nothing(spark):
    assert manifest_rows(spark.createDataFrame([], "doc_id bigint, source string, text string")) == []


def test_proof_finds_a_changed_leaf(spark):
    df = spark.createDataFrame([(i, "a", f"t{i}") for i in range(10)], "doc_id bigint, source string, text string")
    leaf = merkle.leaf_digest([F.col("text")])
    changed = merkle.leaf_digest([F.when(F.col("doc_id") == 4, F.lit("other")).otherwise(F.col("text"))])
    found = merkle.manifest(df, "doc_id", "source", leaf, claimed=changed)
    bad = found.filter(merkle.folded(F.col("claimed"), F.col("path")) != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [4]


def brute_trie(rows):
    """rows (conv, turn, role, text) without ties in turn."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def sums(node):
        leaves, tokens = int(not kids[node]), (len(members[node]) - 1) * len(node[-1][1].split()) if node else 0
        for below in map(sums, kids[node]):
            leaves, tokens = leaves + below[0], tokens + below[1]
        return leaves, tokens

    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), *sums(n),
                   sha(",".join(map(str, sorted(ends[n]))))) for n in members)


def spark_trie(spark, rows, local_nodes):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({"pos": F.lit("x"), "node": F.lit(1), "at": F.lit(2)})
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    placed = trie.placed(trie.turns(df), F.col("conv") - F.col("conv") % 20, head, 3)
    return sorted(map(tuple, trie.trie(placed, local_nodes).collect()))


def conversations(seed, convs, most, words="ab"):
    r = random.Random(seed)
    return [(c, t, r.choice("ua"), " ".join(r.choice(words) for _ in range(r.randrange(3))))
            for c in range(convs) for t in range(r.randrange(1, most))]


def test_trie_equals_brute_force_with_few_and_many_rounds(spark):
    rows = conversations(1, 45, 7) + [(45, None, None, None), (45, 3, "u", None), (None, 1, "u", "x"), (47, 0, "u", "")]
    want = brute_trie(rows)
    assert spark_trie(spark, rows, 4096) == want
    assert spark_trie(spark, rows, 40) == want


def test_trie_of_one_long_conversation_and_copies(spark):
    rows = [(3, t, "u", f"turn {t}") for t in range(80)] + [(c, t, "u", f"same {t}") for c in range(20, 60) for t in range(4)]
    rows += [(200, 1, "u", "x " * 100_000)]
    want = brute_trie(rows)
    assert spark_trie(spark, rows, 40) == want


def test_trie_repeated_turns_and_nothing(spark):
    assert spark_trie(spark, [], 10) == []
    rows = [(1, 5, "u", "same")] * 5
    assert spark_trie(spark, rows, 10) == brute_trie(rows)


def test_decomposed_equals_sums_bottom_up():
    r = random.Random(5)
    for n in (1, 2, 30, 200):
        parents = [-1] + [r.randrange(i) for i in range(1, n)]
        value = [r.randrange(10) for _ in range(n)]
        mass, want = [1] * n, list(value)
        for i in range(n - 1, 0, -1):
            mass[parents[i]] += mass[i]
            want[parents[i]] += want[i]
        assert trie.decomposed(parents, mass, [value], [[0] * n]) == [want]
