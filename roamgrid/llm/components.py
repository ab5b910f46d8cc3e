"""Connected components by alternating stars: joins and minima only, no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not its component's least node, the root.

    Each round points every larger neighbour at the least neighbour (large star), then every node and its smaller
    neighbours at the least of them (small star); it ends when a round changes nothing. Rounds grow with the logarithm of
    the component's size. Lineage is cut after each round.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # the node itself, and its smaller neighbours
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        now = checkpoint(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
