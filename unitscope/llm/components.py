"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from unitscope.llm.durable import durable


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Moves every node's larger neighbours below its smallest neighbour, or itself if it has no smaller one."""
    above = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    return above.join(_lowest(edges).withColumnRenamed("a", "u"), "u", "left").select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Moves every node and its smaller neighbours below the smallest of them."""
    lowest = _lowest(edges)
    moved = edges.join(lowest, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the stored edges (a, b) that has another node: the smallest node reachable.

    Hubs are pre-aggregated before each shuffle; the number of rounds grows with the logarithm of the longest path. A
    round's edges are counted while they are stored, and rounds end once one changes nothing. Loops and edges with a
    null end count for nothing; without edges there are no rows."""
    # From here on every edge goes from the larger to the smaller node.
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    before = None
    while True:
        seen = Observation()
        moved = _small_star(_large_star(edges))
        edges = durable(moved.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("hash")))
        if seen.get == before or not seen.get["n"]:
            break
        before = seen.get
    low = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return low.unionByName(low.select(F.col("component").alias("id"), "component").distinct())
