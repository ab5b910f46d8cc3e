"""Shortest paths from a few sources to many targets, by frontier relaxation: every round relaxes the edges of all nodes
that improved, for all sources at once.

Weights are not negative, so a state only ever improves, and the predecessors, which change with strict improvements
only, never form a cycle. Requests of one source share its search. A round moves its frontier to the edges and the offers
to what is known; both of these lie in buckets of their own key and are read where they lie. A round writes what has
improved, no more: what is known stays in the parts of the rounds before, which are put together now and then and removed.

A source with few targets is searched from both ends instead (``pairs``), a few sources with many are flooded over blocks (``flood``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.operators import landmarks as marks
from roamgrid.operators.flood import flood
from roamgrid.operators.graph import keys, reduced
from roamgrid.operators.pairs import meet
from roamgrid.operators.walk import paths
from roamgrid.plans.lineage import cut, scratch, written

#: Rounds after which the parts are put together.
COMPACT = 6
#: Targets from which on a source is searched once for all of them; sources up to which they are flooded over blocks.
MANY, FEW = 8, 64


def _newest(parts: list[DataFrame]) -> DataFrame:
    """The least distance of each (source, node) and its predecessor: later parts are strictly nearer. No part is moved."""
    pick = lambda a, b: a.withColumnsRenamed({"dist": "d0", "prev": "p0"}).join(b, ["source", "node"], "full").select("source", "node", F.coalesce("dist", "d0").alias("dist"), F.when(F.col("dist").isNotNull(), F.col("prev")).otherwise(F.col("p0")).alias("prev"))
    return reduce(pick, parts)


def nearer(offers: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The offers(source, node, dist, prev) that are nearer than what the parts know; no part is moved."""
    known = []
    for i, part in enumerate(parts):
        offers = offers.join(part.select("source", "node", F.col("dist").alias(f"d{i}")), ["source", "node"], "left")
        known.append(F.col(f"d{i}"))
    least = F.least(*known) if len(known) > 1 else known[0]
    return offers.where(least.isNull() | (F.col("dist") < least)).select("source", "node", "dist", "prev")


def distances(sources: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(source, node, dist, prev) of all nodes reached from sources(source), and the number of rounds.

    With targets(source, node), what is no nearer than the farthest target already reached is not followed. Among equal
    distances of a round the smallest predecessor is kept.
    """
    with scratch(edges.sparkSession) as tables:
        graph = reduced(edges).withColumnRenamed("from_node_id", "node").withColumnRenamed("to_node_id", "next")
        graph = tables.keep(graph, "node")
        none = F.lit(None).cast("long")
        frontier = tables.keep(sources.select("source").distinct().select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), none.alias("prev")), "source", "node")
        parts = [frontier]
        goals = tables.keep(targets.select("source", "node").distinct().withColumn("best", F.lit(None).cast("double")), "source", "node") if targets is not None else None
        rounds = 0
        while True:
            moving = frontier.select("source", "node", "dist")
            if goals is not None:
                goals = tables.keep(goals.join(moving, ["source", "node"], "left").select("source", "node", F.coalesce("dist", "best").alias("best")), "source", "node", lies=True)
                bound = goals.groupBy("source").agg(F.when(F.count_if(F.col("best").isNull()) == 0, F.max("best")).alias("bound"))
                moving = moving.join(bound, "source").where("bound is null or dist < bound").drop("bound")
            step = F.col("dist") + F.col("weight")
            offers = moving.join(graph, "node").select("source", F.col("next").alias("node"), step.alias("nd"), F.col("node").alias("via")).where("nd < 1.7976931348623157e308")
            offers = offers.groupBy("source", "node").agg(F.min(F.struct("nd", "via")).alias("offer")).select("source", "node", F.col("offer.nd").alias("dist"), F.col("offer.via").alias("prev"))
            frontier, counts = tables.keep_counted(nearer(offers, parts), "source", "node", lies=True)
            rounds += 1
            if not counts["rows"]:
                return written(_newest(parts)), rounds
            parts.append(frontier)
            if len(parts) > COMPACT:
                whole = tables.keep(_newest(parts), "source", "node", lies=True)
                tables.drop(*parts[:-1])
                parts = [whole]


def routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(request_id, node_ids, distance) for requests(request_id, source, target) that have a route.

    Both ends must be nodes or starts of edges, also where they are the same node: then it is the way, without a search
    (one would also find ways of no length over other nodes at the same place). With a landmark table of the edges
    (``index``), pairs without a route leave before any search, so that a target out of reach makes no source flood.
    """
    known = keys(nodes, edges)
    for end in ("source", "target"):
        requests = requests.join(known.withColumnRenamed("node", end), end, "left_semi")
    requests = cut(requests.select("request_id", "source", "target"))
    asked = requests.where("source <> target").select("source", "target").distinct()
    if index is not None:
        asked = written(marks.bounded(asked, index).select("source", "target"))
    number = asked.groupBy("source").agg(F.count("*").alias("n"))
    many, few = (written(asked.join(number.where(c), "source", "left_semi")) for c in (F.col("n") > MANY, F.col("n") <= MANY))
    found = []
    if not many.isEmpty():
        goals = many.select("source", F.col("target").alias("node"))
        sources = [r["source"] for r in many.select("source").distinct().limit(FEW + 1).collect()]
        state = flood(sources, edges, goals) if len(sources) <= FEW else distances(many, edges, goals)[0]
        reached = many.join(state.select("source", F.col("node").alias("target"), F.col("dist").alias("distance")), ["source", "target"])
        walks = paths(reached.select("source", F.col("target").alias("node")), state)
        found.append(reached.join(walks.withColumnRenamed("node", "target"), ["source", "target"]))
    if not few.isEmpty():
        found.append(meet(few, edges, index))
    same = requests.where("source = target").select("request_id", F.array("source").alias("node_ids"), F.lit(0.0).alias("distance"))
    if not found:
        return same
    return same.unionByName(requests.join(reduce(DataFrame.unionByName, found), ["source", "target"]).select("request_id", "node_ids", "distance"))
