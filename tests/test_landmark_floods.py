from pyspark.sql import functions as F

from roamgrid.operators import landmarks
from roamgrid.operators.routing import distances
from tests.test_search import frame, road


def test_both_directions_are_one_flood(spark, monkeypatch):
    """Distances to and from landmarks are found in the same rounds, and are those of a search in each direction."""
    edges = frame(spark, road(5)[0])
    calls, keep = [], landmarks.flood
    monkeypatch.setattr(landmarks, "flood", lambda *a, **k: calls.append(a) or keep(*a, **k))
    found = {r["node"]: r for r in landmarks.table(edges, [0, 3]).collect()}
    assert len(calls) == 1
    turned = edges.select(F.col("to_node_id").alias("from_node_id"), F.col("from_node_id").alias("to_node_id"), "weight")
    sources = spark.createDataFrame([(0,), (3,)], "source long")
    for name, e in (("into", edges), ("out", turned)):
        own = {(r["node"], r["source"]): r["dist"] for r in distances(sources, e)[0].collect()}
        assert {(n, s): r[name][i] for n, r in found.items() for i, s in enumerate((0, 3)) if r[name][i] is not None} == own
