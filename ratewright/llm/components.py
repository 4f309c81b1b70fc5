"""Connected components of a table of links, by alternating stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.sources.tables import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or the node itself)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them. ``a`` is the larger end of each link."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    tied = links.join(least, "a")
    down = tied.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return down.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, roots left out. ``links`` has columns a and b.

    Stars shrink paths by half or more each round; every round is written to the shared folder, so no lineage grows. Aggregates
    combine before their shuffle and the joins may be split, so a node with very many links is no hot spot.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = written(links)
    before = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        state = written(_small_star(_large_star(state)))
