"""Sharding by balanced label propagation: linked documents move together while shards keep equal numbers of rows.

Nodes are groups of equal texts (a group larger than a shard is cut into parts of at most one shard). Links are hubs: a
line that stands in several texts links them all with one row each, never pair by pair. Each round every hub
names the shard that holds most of its rows, every node wants the shard most of its hubs name, and as many of those who
want a shard are let in as its quota has room for once those who want to leave are gone, drawn by a hash. At the end shards above their size give
rows to shards below: unlinked ones first, and in the order of their groups, so that few groups are cut.

The law is `rows`: sizes differ by at most one. Loads, quotas and the plan of the last moves are tables with one row per
shard; rows are numbered in buckets with a sum of the buckets before, so no shard is sorted as a whole.

Defined cases: a null text counts as an empty one and is equal to it. Repeated rows are rows of their own. Null ids are
carried. An empty table gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.llm.common import SPACE, empty_if_null, saved

SHARDS = 40
ROUNDS = 3
# Shards may exceed their size by this part while labels move.
SLACK = 0.05
# Shorter lines link nothing.
LEAST_CHARS = 24
# Rows that are numbered by one task.
BUCKET_ROWS = 5_000


def line_hubs(docs: DataFrame, text: str) -> DataFrame:
    """(grp, hub): lines that stand in at least two different texts, once for each text."""
    line = F.btrim(F.col("line"), F.lit(SPACE))
    rows = docs.select(F.xxhash64(empty_if_null(text)).alias("grp"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    rows = rows.filter(F.length(line) >= LEAST_CHARS).select("grp", F.xxhash64(line).alias("hub"))
    several = rows.groupBy("hub").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).filter("a <> b").select("hub")
    return saved(rows.join(several, "hub", "left_semi").distinct(), "hubs")


def _top(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """For each key the shard with the largest weight."""
    sums = df.groupBy(key, "shard").agg(weight.alias("w"))
    return sums.groupBy(key).agg(F.max_by("shard", F.struct("w", "shard")).alias("wanted"))


def propagate(nodes: DataFrame, hubs: DataFrame, shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """nodes (node, grp, n, shard) with shards moved towards those of linked nodes, within quotas."""
    now = nodes
    for r in range(rounds):
        member = hubs.join(now, "grp").select("hub", "node", "n", "shard")
        called = _top(member, "hub", F.sum("n")).withColumnRenamed("wanted", "shard")
        wishes = _top(member.select("hub", "node").join(called, "hub"), "node", F.count("*"))
        load = now.groupBy("shard").agg(F.sum("n").alias("load"))
        movers = saved(now.join(wishes, "node").filter("wanted <> shard").select("node", "n", "shard", "wanted"), "wishes")
        asked = movers.groupBy("wanted").agg(F.sum("n").alias("asked"))
        leaving = movers.groupBy(F.col("shard").alias("wanted")).agg(F.sum("n").alias("leaving"))
        there = asked.join(load.withColumnRenamed("shard", "wanted"), "wanted", "left").join(leaving, "wanted", "left")
        free = F.lit(quota) - F.coalesce("load", F.lit(0)) + F.coalesce("leaving", F.lit(0))
        room = there.select("wanted", (F.greatest(F.lit(0.0), free) / F.col("asked")).alias("part"))
        draw = F.pmod(F.xxhash64(F.lit(r), "node"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moved = movers.join(F.broadcast(room), "wanted").filter(
            draw < F.col("part")).select("node", "wanted")  # a row a shard
        now = saved(now.join(moved, "node", "left").withColumn("shard", F.coalesce("wanted", "shard")).drop("wanted"), "labels")
    return now


def numbered(df: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """`place` of every row within its group, gapless from 0, in the order of the columns `order` (integers) up to
    ties; rows: about how many rows share all of `order`, at most."""
    keys = [group, *order]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = saved(sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "bucket-sizes")
    own = Window.partitionBy(*keys).orderBy("__tie", "doc_id")
    return df.join(sizes, keys).withColumn("place", F.col("__before") + F.row_number().over(own) - 1).drop("__before")


def _plan(counts: dict[int, int], total: int, shards: int) -> list[tuple[int, int, int]]:
    """For each shard its size, the number of its first row given away, and the number of its first row taken in."""
    low, more = divmod(total, shards)
    largest = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))[:more]
    size = {s: low + (s in set(largest)) for s in range(shards)}
    plan, given, taken = [], 0, 0
    for s in range(shards):
        plan.append((size[s], given, taken))
        given += max(0, counts.get(s, 0) - size[s])
        taken += max(0, size[s] - counts.get(s, 0))
    return plan


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS,
           slack: float = SLACK) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32, shard, slot (gapless from 0 within the shard)."""
    body = empty_if_null(text)
    rows = saved(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("grp")), "rows")
    total = rows.count()
    quota = -(-total // shards) if total else 1
    groups = rows.groupBy("grp").agg(F.count("*").alias("all"))
    part_count = F.ceil(F.col("all") / F.lit(quota))
    # part 0 for nearly all groups; the parts of a large group start on different shards
    cut = saved(groups.filter(F.col("all") > quota).select("grp", part_count.alias("parts")), "large-groups")
    rows = rows.join(cut, "grp", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("parts")), F.lit(0))).drop("parts").withColumn(
        "node", F.xxhash64("grp", "part"))
    rows = saved(rows, "rows")
    nodes = saved(rows.groupBy("node", "grp", "part").agg(F.count("*").alias("n")).withColumn(
        "shard", F.pmod(F.pmod(F.xxhash64(F.lit(1), "grp"), F.lit(shards)) + F.col("part"), F.lit(shards)).cast("int")).drop(
        "part"), "nodes")
    hubs = line_hubs(docs, text)
    nodes = propagate(nodes, hubs, shards, quota * (1 + slack), rounds)
    # rows are given away in the order of a hub, so that its members leave together
    anchors = hubs.groupBy("grp").agg(F.min("hub").alias("anchor"))
    nodes = nodes.join(anchors, "grp", "left").withColumn(
        "loose", F.when(F.col("anchor").isNotNull() | (F.col("n") > 1), 0).otherwise(1)).select(
        "node", "shard", "loose", F.coalesce("anchor", "node").alias("anchor"), F.col("n").alias("node_rows"))
    around = nodes.groupBy("anchor").agg(F.sum("node_rows").alias("anchor_rows"))
    nodes = saved(nodes.join(around, "anchor"), "nodes")
    buckets = max(1, total // (shards * BUCKET_ROWS))
    # in the hash order of the hubs, the rows of a node next to each other; a large node or hub has several buckets
    labelled = saved(rows.join(nodes, "node").withColumns({
        "b": F.pmod(F.xxhash64(F.lit(2), "anchor"), F.lit(buckets)),
        "c": F.when(F.col("node_rows") > BUCKET_ROWS, F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.ceil(
            F.col("node_rows") / F.lit(BUCKET_ROWS))) + 1).when(
            F.col("anchor_rows") > BUCKET_ROWS, -1 - F.pmod(F.xxhash64(F.lit(4), "node"), F.ceil(
                F.col("anchor_rows") / F.lit(BUCKET_ROWS)))).otherwise(F.lit(0)), "__tie": F.struct("anchor", "node")}), "labelled")
    counts = {r["shard"]: r["n"] for r in labelled.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    plan = _plan(counts, total, shards)
    size, given, taken = (F.lit([p[k] for p in plan]) for k in range(3))
    at = lambda array, s: F.element_at(array, s + 1)
    placed = saved(numbered(labelled, "shard", ["loose", "b", "c"], BUCKET_ROWS), "placed")
    over = F.col("place") >= at(size, F.col("shard"))
    rank = at(given, F.col("shard")) + F.col("place") - at(size, F.col("shard"))
    # the shard that takes in row `rank` is the last whose first number is not above it and which lacks rows
    lacking = [(s, plan[s][2]) for s in range(shards) if counts.get(s, 0) < plan[s][0]]
    target = F.lit(0)
    for s, first in lacking:
        target = F.when(F.col("rank") >= first, F.lit(s)).otherwise(target)
    held = F.lit([counts.get(s, 0) for s in range(shards)])
    placed = placed.withColumn("rank", F.when(over, rank)).withColumn("to", F.when(over, target))
    return placed.select(
        "doc_id", "size", "text_crc32", F.coalesce("to", "shard").cast("int").alias("shard"),
        F.when(over, at(held, F.col("to")) + F.col("rank") - at(taken, F.col("to"))).otherwise(F.col("place")).cast(
            "bigint").alias("slot"))


def query(spark, folder: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
