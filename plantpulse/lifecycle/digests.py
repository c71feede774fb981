"""Trees of digests over key ranges: two copies of a table are compared from the root, only what differs is read.

A row belongs to the leaf that its key hashes to; 256 leaves form a node, 256 nodes the root. The digest of a
leaf sums a part of its rows' MD5, so it needs no order and equal rows do not cancel; nodes and the root sum
their children. A tree has at most 65,793 rows whatever the size of the table, and is stored beside a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.sinks.tables import gathered

FAN = 256
NODE, LEAF = "__node", "__leaf"
WHOLE_NUMBER = "decimal(38,0)"


def row_digest(df: DataFrame) -> Column:
    """60 bits of the MD5 of a row: all columns by name, NULL told from an empty text, maps in the order of their keys."""
    kinds = dict(df.dtypes)
    columns = [c for c in sorted(df.columns) if c not in (NODE, LEAF)]
    fields = [(F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.col(f"`{c}`")).alias(c) for c in columns]
    text = F.to_json(F.struct(*fields), {
        "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast(WHOLE_NUMBER)


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the node and the leaf of a row; a table stored by node keeps its partition column."""
    leaf = F.pmod(F.xxhash64(*keys), F.lit(FAN * FAN)).cast("int")
    rows = df.withColumn(LEAF, leaf)
    return rows if NODE in df.columns else rows.withColumn(NODE, F.floor(F.col(LEAF) / FAN).cast("int"))


def digest_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """(level, node, leaf, rows, digest): level 0 the root, 1 the nodes, 2 the leaves. The table is read once."""
    leaves = placed(df, keys).withColumn("__d", row_digest(df)).groupBy(NODE, LEAF).agg(
        F.count("*").alias("rows"), F.sum("__d").alias("digest"))
    return leaves.rollup(NODE, LEAF).agg(
        F.when(F.grouping(NODE) == 1, 0).when(F.grouping(LEAF) == 1, 1).otherwise(2).alias("level"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sum("digest").cast(WHOLE_NUMBER).alias("digest"),
    ).select("level", F.col(NODE).alias("node"), F.col(LEAF).alias("leaf"), "rows", "digest")


def save_copy(df: DataFrame, keys: list[str], path: str) -> None:
    """A copy stored by node with its tree. The tree is computed from the stored rows."""
    gathered(placed(df, keys).drop(LEAF), NODE).write.mode("overwrite").partitionBy(NODE).parquet(f"{path}/rows")
    stored = read_copy(df.sparkSession, path)
    digest_tree(stored, keys).write.mode("overwrite").partitionBy("level").parquet(f"{path}/tree")


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tree")


def _unlike(before: DataFrame, after: DataFrame, level: int, nodes: list[int] | None = None) -> DataFrame:
    """Places of a level that differ, below the given nodes."""
    sides = before.unionByName(after).filter(F.col("level") == level)
    if nodes is not None:
        sides = sides.filter(F.col("node").isin(nodes))
    # what both trees say alike comes twice
    return (sides.groupBy("node", "leaf", "rows", "digest").count().filter("count = 1")
            .select("node", "leaf").distinct())


def differing_nodes(before: DataFrame, after: DataFrame) -> list[int]:
    """Nodes of two trees that differ, none if the roots agree; at most 256 numbers."""
    if _unlike(before, after, 0).isEmpty():
        return []
    return sorted(r["node"] for r in _unlike(before, after, 1).collect())


def differences(before: DataFrame, after: DataFrame, keys: list[str], before_tree: DataFrame, after_tree: DataFrame) -> DataFrame:
    """(keys, kind, rows_before, rows_after) of every key whose rows differ: ADDED, REMOVED or CHANGED.

    Copies stored by node are read only in the nodes that differ. Rows of other leaves are dropped before the
    shuffle, and a key's rows are summed up before it, so a key with very many rows is one row per task.
    Both tables need the same columns and types. Rows without a key are compared as the rows of the NULL key.
    """
    nodes = differing_nodes(before_tree, after_tree)
    leaves = F.broadcast(_unlike(before_tree, after_tree, 2, nodes).select(F.col("leaf").alias(LEAF)))

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        rows = placed(df, keys).filter(F.col(NODE).isin(nodes)) if nodes else placed(df, keys).filter(F.lit(False))
        found = rows.withColumn("__d", row_digest(df)).join(leaves, LEAF, "left_semi")
        return found.select(*keys, F.lit(1).alias(f"__{own}"), F.lit(0).alias(f"__{other}"),
                            F.col("__d").alias(f"__{own}_d"), F.lit(0).cast(WHOLE_NUMBER).alias(f"__{other}_d"))

    was, now = F.col("rows_before"), F.col("rows_after")
    return (
        side(before, "b", "a").unionByName(side(after, "a", "b")).groupBy(*keys)
        .agg(F.sum("__b").alias("rows_before"), F.sum("__a").alias("rows_after"), F.sum("__b_d").alias("__x"), F.sum("__a_d").alias("__y"))
        .filter((was != now) | (F.col("__x") != F.col("__y")))
        .select(*keys, F.when(was == 0, "ADDED").when(now == 0, "REMOVED").otherwise("CHANGED").alias("kind"), "rows_before", "rows_after"))
