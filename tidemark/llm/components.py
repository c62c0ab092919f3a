"""Connected components of a link table, by joins and aggregates that halve paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all ends of links(a, b); component is the least node reached. No links, no rows.

    Large-star and small-star steps in turn: each node's larger neighbours, then all smaller ones, are tied to its least
    neighbour, until the links are stars. Every step ends in a written table. The number of rounds grows with the square
    of the logarithm of the number of nodes at worst, in practice with the logarithm of the longest chain. The hub of a
    large component has many rows on one side of a join and one on the other, so adaptive execution splits it.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").where("x > m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        edges = stored(small, "small")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", "v").toDF("node", "component")).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Number of edges, and two sums over their hashes: the same for the same set of edges, and hardly for any other."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())
