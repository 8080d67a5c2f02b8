"""Connected components of an undirected link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``links(a, b)``.

    Alternates two star operations until no link changes: every node hands its
    larger neighbours, then its smaller ones, to the smallest node it knows. The
    smallest neighbour is a minimum, so it is combined before the shuffle, and a
    node with many links is a plain skewed join key, which the engine splits.
    Rounds grow with the logarithm of the longest chain. Links with a null end
    and links of a node to itself are ignored.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, _state(edges)
    while now != before:
        edges = cut(_small_star(_large_star(edges)))
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the links."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links (larger neighbour of a node, smallest neighbour or the node itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links (node or smaller neighbour, smallest neighbour)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
