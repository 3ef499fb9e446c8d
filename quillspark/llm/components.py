"""Connected components of an edge list by alternating large-star and small-star steps, all in DataFrames.

Nodes are longs. Null ends, loops and repeated edges say nothing; an empty list gives an empty table. Columns other than
a and b are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node goes to the least node of that neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lower neighbours go to the least of them. edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for each node of edges (a, b); the component is its least node."""
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983))
    before = None
    for _ in range(rounds):
        edges = stage(_small_star(_large_star(edges)), "stars")
        now = edges.agg(digest.alias("d")).first()["d"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
