"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameweave.plans.staging import materialise, small_side


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `links` (a, b); root is the least node reached.

    Each round hangs the neighbours of a node on its least neighbour, first the larger ones, then
    the smaller ones, until all nodes hang on a root directly; that takes a logarithmic number of
    rounds in practice. The state is the table of links, written out in each round, which also cuts
    the lineage. Least neighbours are aggregated before they are joined back, and a hub with most of
    the links is split by the adaptive join, as both sides of it are read from files.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(edges)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")))
        large = both.where("b > a").join(small_side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node that is its neighbourhood's least keeps its larger neighbours, which is the same row.
        large = materialise(large.where("a <> b").distinct())
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        hung = large.join(small_side(least), "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        nodes = edges.agg(F.count(F.lit(1)).alias("links"), F.count_distinct("a").alias("nodes")).first()
        roots = edges.select(F.col("b").alias("a")).distinct()
        if nodes.links == nodes.nodes and edges.join(roots, "a", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
