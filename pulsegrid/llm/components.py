"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b): each node's neighbours are linked to the smallest node next to it.

    The large star moves the neighbours above the node, the small star those below it and the node itself.
    The smallest neighbour is an aggregate with partial sums and is joined back, so no neighbour list is
    gathered and a node with very many links is a skewed join, which Spark splits.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("m", "a").alias("m"))
    moved = both.join(low, both.a == low.node)
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; a component is named by its smallest node.

    Edges point from the larger node to the smaller. Each round is written to the shared folder. The
    number of rounds grows with the logarithm of the longest chain.
    """
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if not now.n or now == before:
            break
        before = now
        edges = store(_star(_star(edges, True), False), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
