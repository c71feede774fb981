"""Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf. Leaves are ranked within their group; the base-3 digits of the rank say which leaves share a
parent at which level. Rows go to blocks of 3^6 neighbouring leaves, once; within a block the last digit is grouped
away, then the next, each time nesting the children's structs in their parent's. The tops of the blocks are the leaves
of the next pass, until a group has one top left, its subroot; the subroots of all groups, in order, are the leaves of
the last tree. On the way back a block meets the path of its own top in one grouping, and nested transforms and one
explode give each leaf its siblings. Nothing but the rank is found by a join, and no row holds more than one block.

A group of any size is many blocks, so a hot source is spread like the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import saved
from plantpulse.llm.ranks import ranked

ARITY = 3
# Levels of one block: 729 leaves, about 100 KB as nested structs.
LEVELS = 6
_SIZE = ARITY ** LEVELS
_STEPS = "array<struct<before: string, after: string>>"


def field_text(column: Column) -> Column:
    """A value as it enters its leaf: `-` for null, else its length in UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def _left(level: int) -> Column:
    """Nodes of the group that are left at a level."""
    size = ARITY ** level
    return F.expr(f"(n + {size - 1}) div {size}")


def _blocks(nodes: DataFrame) -> DataFrame:
    """nodes (g, n, r, h, body) rolled up to one row per block: g, n, block, h, body (the nested children).

    All groupings use the keys the rows were dealt by, so the rows move once."""
    now = (nodes.select("g", "n", F.expr(f"r div {_SIZE}").alias("block"), F.expr(f"r % {_SIZE}").alias("i"), "h", "body")
           .repartition("g", "block"))
    for level in range(LEVELS):
        child = F.struct(F.expr(f"i % {ARITY}").alias("digit"), "h", "body").alias("child")
        now = (now.select("g", "n", "block", F.expr(f"i div {ARITY}").alias("i"), child)
               .groupBy("g", "block", "n", "i").agg(F.sort_array(F.collect_list("child")).alias("body")))
        joined = F.sha2(F.concat_ws("", F.transform("body", lambda c: c["h"])), 256)
        now = now.withColumn("h", F.when(_left(level) > 1, joined).otherwise(F.col("body")[0]["h"]))
    return now.select("g", "n", "block", "h", "body")


def _step(siblings: Column, own: Column) -> Column:
    def side(keep):
        return F.concat_ws("", F.transform(F.filter(siblings, keep), lambda s: s["h"]))
    return F.struct(side(lambda s: s["digit"] < own["digit"]).alias("before"), side(lambda s: s["digit"] > own["digit"]).alias("after"))


def _children(real: Column):
    """A node's children, each with its path; where the group had one node left, the level adds no step."""
    def of(node):
        def child(c):
            step = F.when(real, F.array(_step(node["body"], c))).otherwise(F.array().cast(_STEPS))
            return F.struct(c["body"].alias("body"), c["h"].alias("h"), F.concat(step, node["path"]).alias("path"))
        return F.transform(node["body"], child)
    return of


def _opened(blocks: DataFrame) -> DataFrame:
    """blocks (g, n, body, path, ...) opened to their leaves: `leaf` is (body, h, path)."""
    nodes = F.array(F.struct("body", F.lit("").alias("h"), "path"))
    for level in reversed(range(LEVELS)):
        blocks = blocks.withColumn("nodes", F.flatten(F.transform(nodes, _children(_left(level) > 1))))
        nodes = F.col("nodes")
    return blocks.withColumn("leaf", F.explode("nodes")).drop("nodes", "body", "path")


def _proofs(nodes: DataFrame, groups: bool) -> DataFrame:
    """nodes (g, n, r, h, body) with their paths: g, h, body, path, subroot, root.

    With `groups`, the tops of the groups are put under one root; else the one group's top is the root."""
    blocks = saved(_blocks(nodes), "merkle-blocks")
    left = blocks.agg(F.max(_left(LEVELS))).first()[0] or 0
    if left > 1:
        upper = _proofs(blocks.select("g", _left(LEVELS).alias("n"), F.col("block").alias("r"), "h", F.struct("block").alias("body")), groups)
        upper = upper.select("g", F.col("body.block").alias("block"), "path", "subroot", "root")
    elif groups:
        tops = ranked(blocks.select("g", "h"), [], ["g"], "merkle-tops")
        tops = _proofs(tops.select(F.lit(0).alias("g"), F.col("n_group").alias("n"), F.col("rank").alias("r"), "h",
                                   F.struct("g").alias("body")), False)
        upper = tops.select("body.g", F.lit(0).cast("bigint").alias("block"), "path", F.col("h").alias("subroot"), "root")
    else:
        upper = blocks.select("g", "block", F.array().cast(_STEPS).alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    both = blocks.drop("h").unionByName(upper, allowMissingColumns=True).groupBy("g", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "body", "path", "subroot", "root")])
    return _opened(both).select("g", "leaf.*", "subroot", "root")


def manifest(df: DataFrame, key: str, group: str, leaf: Column, **carried: Column) -> DataFrame:
    """One row per input row: key, leaf, subroot (of its group), root, path, and the carried columns.

    Within a group leaves ascend by key (null first), then by leaf; equal rows are leaves of their own. Every three
    neighbours become their parent (the last run may be shorter) while a group has more than one node; the subroots,
    by group (null first, bytewise), are joined likewise. `path` lists per level the digests `before` and `after` the
    node. An empty table gives no rows; a null group is a group. Texts are hashed where they are read, whole, and do
    not travel; other columns of the input, whatever their names, take no part.
    """
    carried = {"key": F.col(key), **carried}
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), leaf.alias("h"),
                     F.struct(*[c.alias(n) for n, c in carried.items()]).alias("body"))
    rows = ranked(rows, ["g"], ["k", "h"], "merkle-leaves")
    found = _proofs(rows.select("g", F.col("n_group").alias("n"), F.col("rank").alias("r"), "h", "body"), True)
    return found.select(F.col("body.key").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path",
                        *[F.col("body")[n].alias(n) for n in carried if n != "key"])


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def query(spark, folder: str) -> DataFrame:
    """Every document's proof, checked against a copy in which every other text has lost its line ends."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, "doc_id", "source", leaf_digest([F.col(c) for c in FIELDS]),
                     claimed=leaf_digest([text if c == "text" else F.col(c) for c in FIELDS]))
    found = found.withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(c: str, value: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value})::VARCHAR || ':' || {value} END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c, text if c == "text" else f"{c}::VARCHAR") for c in FIELDS) + ")"


# Start and polynomial of CRC-32. Its last bit is flipped at the end, so an even sum is an odd register.
_ODD = """list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda x: list_transform(range(8), lambda k: ((ascii(x) >> k::INTEGER) & 1)::UBIGINT)))),
  lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) % 2 = 1"""


def _sql_tree(name: str, leaves: str, g: str) -> str:
    """Levels of the trees over `leaves` (g, r, n, h) and the path of each leaf as before|after steps."""
    return f"""
{name} AS (SELECT {g} AS g, 0 AS lv, r, n, h FROM {leaves}
  UNION ALL SELECT g, lv + 1, r // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY r)) FROM {name} WHERE n > 1 GROUP BY g, lv, r // 3),
{name}_top AS (SELECT g, h FROM {name} WHERE n = 1),
{name}_step AS (SELECT a.g, a.lv, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') || '|' ||
    coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS step
  FROM {name} a JOIN {name} b ON a.g IS NOT DISTINCT FROM b.g AND a.lv = b.lv AND a.r // 3 = b.r // 3 WHERE a.n > 1 GROUP BY ALL),
{name}_path AS (SELECT l.{g} AS g, l.r, coalesce(list(s.step ORDER BY s.lv) FILTER (s.step IS NOT NULL), []) AS steps
  FROM {leaves} l LEFT JOIN {name}_step s ON l.{g} IS NOT DISTINCT FROM s.g AND s.r = l.r // (3 ** s.lv)::BIGINT GROUP BY ALL)"""


ORACLE = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {_sql_leaf('text')} AS h,
    CASE WHEN {_ODD} THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
{_sql_tree('low', 'leaves', 'source')},
subs AS (SELECT g AS source, h, 0 AS one, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM low_top),
{_sql_tree('high', 'subs', 'one')},
paths AS (SELECT l.doc_id, l.h, l.claimed, s.h AS subroot, list_concat(p.steps, q.steps) AS steps
  FROM leaves l JOIN low_path p ON l.source IS NOT DISTINCT FROM p.g AND l.r = p.r
  JOIN subs s ON l.source IS NOT DISTINCT FROM s.source JOIN high_path q ON q.r = s.r),
done AS (SELECT *, list_reduce(list_prepend(claimed, steps), lambda node, x: sha256(split_part(x, '|', 1) || node || split_part(x, '|', 2))) AS folded_root FROM paths)
SELECT doc_id, h AS leaf, subroot, t.root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = t.root AS verified
FROM done, (SELECT h AS root FROM high_top) t
"""
