"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import staged


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m) for every edge u-v, with m the least of u and its neighbours. Minima are combined before the shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one lower neighbour at most and none that has one itself: then the edges are the components."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable), for the nodes of links(a, b) but the least ones; self links are ignored.

    Every round is staged, so none recomputes an earlier one. Ends when the edges are stars.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "links")
    raise RuntimeError(f"no components after {max_rounds} rounds")
