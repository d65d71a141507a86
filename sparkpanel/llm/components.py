"""Connected components of an edge table by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge (u, v) of longs touches; component is the smallest node reachable.

    Each round replaces the edges of a node by edges to its smallest neighbour, so the longest path shrinks fast.  Minima
    are pre-aggregated and joined back, so a node with very many edges is never gathered in one task.  Every round is
    written to the shared folder; only its edge count and checksum reach the driver.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(),
                "edges")
    before = None
    for _ in range(rounds):
        after = _signature(now)
        if after == before:
            break
        before = after
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stage(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(lowest, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .union(lowest.select("u", F.col("low").alias("v"))).distinct())
        now = stage(small, "small-star")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
