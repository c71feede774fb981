"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import saved


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """For every left end the least right end; partial sums spare a hub its rows in the shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = _least_neighbour(down)
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; edges are (a, b), root is the least node of the component.

    Alternates two star steps until nothing changes; each round is written to the shared folder. The number of
    rounds grows with the logarithm of the longest path, not with the number of nodes.
    """
    now, mark = saved(_small_star(edges), "stars"), None
    while True:
        print_of = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        seen = now.agg(F.count("*").alias("n"), print_of).first()
        if seen == mark:
            break
        mark = seen
        now = saved(_small_star(_large_star(now)), "stars")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
