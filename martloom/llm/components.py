"""Connected components of a link table, in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) that is not itself the smallest it reaches.

    Alternates large-star and small-star steps: each node's larger, then its smaller
    neighbours are linked to the smallest of its neighbourhood, until nothing changes. The
    steps are grouped minima joined back to the links, so a node with very many links is
    aggregated before it is shuffled. Every step is written, so a lost executor repeats one
    step at most.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = cut(ordered, "links"), None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), "star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Changes with the edges: their number and sums of two hashes."""
    parts = [F.count("*")] + [
        F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)
    ]
    return tuple(edges.agg(*[p.alias(str(i)) for i, p in enumerate(parts)]).first())
