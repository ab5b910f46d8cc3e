import random

import pytest
from pyspark.sql import functions as F

from roamgrid.operators import flood, routing


def least(edges, source):
    found, open_ = {source: 0.0}, [source]
    while open_:
        a = open_.pop()
        for f, t, w in edges:
            if f == a and found[a] + w < found.get(t, 1e308):
                found[t] = found[a] + w
                open_.append(t)
    return found


@pytest.mark.parametrize("size", [flood.BLOCK, 24])
def test_blocks_have_the_floods_of_single_rows(spark, size):
    """A hub with edges to all, equal ways, weights of zero, an island, a negative id, a source without edges; blocks of a few edges and in parts."""
    draw = random.Random(5)
    edges = [(a, draw.randrange(60), float(draw.randrange(4))) for a in range(60) for _ in range(3)] + [(7, k, 9.0) for k in range(60)] + [(59, -3, 1.0), (-3, 80, 0.0), (90, 91, 1.0)]
    rows = spark.createDataFrame(edges, "from_node_id long, to_node_id long, weight double")
    sources = [0, 7, 90, 99, -3]
    state = flood.flood(sources, rows, size=size).collect()
    found = {(r["source"], r["node"]): r["dist"] for r in state}
    assert len(found) == len(state) and found == {(s, n): d for s in sources for n, d in least(edges, s).items()}
    prev = {(r["source"], r["node"]): r["prev"] for r in state}
    by_rows = routing.distances(spark.createDataFrame([(s,) for s in sources], "source long"), rows)[0]
    assert prev == {(r["source"], r["node"]): r["prev"] for r in by_rows.collect()}


def test_a_flood_ends_at_its_goals_and_its_state_is_few_rows(spark):
    edges = spark.range(400).select(F.col("id").alias("from_node_id"), (F.col("id") + 1).alias("to_node_id"), F.lit(1.0).alias("weight"))
    goals = spark.createDataFrame([(0, 5), (0, 9), (200, 203)], "source long, node long")
    state = {(r["source"], r["node"]): r["dist"] for r in flood.flood([0, 200], edges, goals).collect()}
    assert state[0, 9] == 9.0 and state[200, 203] == 3.0 and (0, 12) not in state and (200, 206) not in state


def test_a_few_sources_with_many_targets_are_flooded_over_blocks(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(routing, "flood", lambda sources, edges, goals: asked.append(sources) or flood.flood(sources, edges, goals))
    edges = spark.range(20).select(F.col("id").alias("from_node_id"), (F.col("id") + 1).alias("to_node_id"), F.lit(1.0).alias("weight"))
    nodes = spark.range(21).withColumns({"lat": F.lit(0.0), "lng": F.lit(0.0)})
    requests = spark.range(21).select(F.col("id").alias("request_id"), F.lit(0).cast("long").alias("source"), F.col("id").alias("target"))
    found = {r["request_id"]: (r["node_ids"], r["distance"]) for r in routing.routes(requests, nodes, edges).collect()}
    assert asked == [[0]] and found == {k: (list(range(k + 1)), float(k)) for k in range(21)}
