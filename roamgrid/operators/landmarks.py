"""Landmarks: distances to and from a few far-out nodes, which bound every other distance by the triangle inequality.

A node's row holds ``out`` (distances to the landmarks) and ``into`` (distances from them), null where there is no way.
Whether a way exists at all follows from them too: what a landmark reaches while it does not reach the target cannot lead
there, and what reaches a landmark that the source does not reach cannot come from the source. A landmark within the
large strongly connected part of a map so decides every pair with an end in that part, without a search.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.operators.flood import flood
from roamgrid.plans.lineage import written

INFINITE = float("inf")
#: Distances are sums in different orders: bounds are loosened by this share.
LOOSE = 1e-9


def choose(nodes: DataFrame, edges: DataFrame, number: int = 8) -> list[int]:
    """Nodes farthest out in ``number`` directions, of those with at least three neighbours (none: of all); one pass."""
    ends = F.explode(F.array(F.struct(F.col("from_node_id").alias("id"), F.col("to_node_id").alias("other")), F.struct(F.col("to_node_id").alias("id"), F.col("from_node_id").alias("other"))))
    degree = edges.select(ends.alias("x")).select("x.*").where("id <> other").distinct().groupBy("id").agg(F.count("*").alias("n"))
    places = written(nodes.select("id", "lat", "lng").where("lat is not null and lng is not null").join(degree.where("n > 2"), "id", "left"))
    for held in (places.where("n is not null"), places):
        turn = [2 * math.pi * k / number for k in range(number)]
        row = held.agg(*(F.max_by("id", F.struct(F.cos(F.lit(a)) * F.col("lat") + F.sin(F.lit(a)) * F.col("lng"), "id")).alias(f"l{i}") for i, a in enumerate(turn))).first()
        if found := sorted({x for x in row if x is not None}):
            return found
    return []


def table(edges: DataFrame, chosen: list[int]) -> DataFrame:
    """(node, out, into) of every node that reaches a landmark or is reached by one, arrays in the order of ``chosen``."""
    # both directions in the same rounds: even numbers are nodes, odd ones nodes of the map with all edges turned
    ahead = edges.select((F.col("from_node_id") * 2).alias("from_node_id"), (F.col("to_node_id") * 2).alias("to_node_id"), "weight")
    turned = edges.select((F.col("to_node_id") * 2 + 1).alias("from_node_id"), (F.col("from_node_id") * 2 + 1).alias("to_node_id"), "weight")
    found = flood(chosen, ahead.unionByName(turned), begin=lambda x: [2 * x, 2 * x + 1])
    rows = found.select(F.shiftright("node", 1).alias("node"), "source", "dist", (F.col("node") % 2 == 0).alias("ahead"))
    column = lambda c, name: F.map_from_entries(F.collect_list(F.when(c, F.struct("source", "dist")))).alias(name)
    both = rows.groupBy("node").agg(column(~F.col("ahead"), "out"), column(F.col("ahead"), "into"))
    row = lambda name: F.array(*(F.try_element_at(name, F.lit(x)) for x in chosen)).alias(name)
    return written(both.select("node", row("out"), row("into")))


def at_least(out_a: str, into_a: str, out_b: str, into_b: str) -> Column:
    """No way from a to b is shorter than this; infinite where there is none, 0 where nothing is known."""
    # from a landmark: into_b <= into_a + d; to a landmark: out_a <= d + out_b
    by_into = F.zip_with(into_a, into_b, lambda a, b: F.when(a.isNull(), 0.0).when(b.isNull(), INFINITE).otherwise(b - a))
    by_out = F.zip_with(out_a, out_b, lambda a, b: F.when(b.isNull(), 0.0).when(a.isNull(), INFINITE).otherwise(a - b))
    least = F.greatest(F.lit(0.0), F.coalesce(F.array_max(by_into), F.lit(0.0)), F.coalesce(F.array_max(by_out), F.lit(0.0)))
    return least * (1 - LOOSE)


def at_most(out_a: str, into_b: str) -> Column:
    """A way over the best landmark; null where none connects them."""
    return F.array_min(F.zip_with(out_a, into_b, lambda a, b: a + b)) * (1 + LOOSE)


def bounded(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The asked(source, target) that may have a route, with ``bound`` (an upper bound, or null) and the rows of both ends."""
    end = lambda name: index.select(F.col("node").alias(name), F.col("out").alias(f"at_{name}_out"), F.col("into").alias(f"at_{name}_into"))
    both = asked.join(end("source"), "source", "left").join(end("target"), "target", "left")
    for name in ("source", "target"):
        for way in ("out", "into"):
            both = both.withColumn(f"at_{name}_{way}", F.coalesce(f"at_{name}_{way}", F.array().cast("array<double>")))
    bound = F.when(F.col("source") == F.col("target"), F.lit(0.0)).otherwise(at_most("at_source_out", "at_target_into"))
    least = at_least("at_source_out", "at_source_into", "at_target_out", "at_target_into")
    return both.withColumn("bound", bound).where((F.col("source") == F.col("target")) | (least < INFINITE))
