"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Self loops and repeated edges do no harm, edges with a null end are left out, no edges
    give no rows.  The edges stay distributed: only their number and a checksum reach the
    driver.  A node of very many edges is one side of a join, which adaptive execution splits.
    """
    edges, last = settle(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()), None
    now = _state(edges)
    while now[0] and now != last:
        edges = merged(edges, now[0])
        edges, last = settle(merged(_small_star(merged(_large_star(edges), now[0])), now[0])), now
        now = _state(edges)
    edges = merged(edges, now[0])
    return edges.union(edges.select("v", "v").distinct()).toDF("node", "component")
