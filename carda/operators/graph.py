"""Connected components by alternating large-star and small-star steps; edges only ever shuffle by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carda.session import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node of its neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node of the part. Null ends, loops and repeated edges add nothing.

    Rounds go on until nothing changes, which takes a number that grows with the logarithm of the nodes.
    A hub with a third of all edges is safe: a node's neighbourhood is only ever reduced by ``min``, never collected.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = e.where("u = v").select("u").distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = signature(e)
    while True:
        e = cut(_small_star(_large_star(e)))
        now = signature(e)
        if now == before:
            break
        before = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return members.unionByName(heads).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
