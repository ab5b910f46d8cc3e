"""An overlay of cells: the map is cut into bounded cells, and a search goes from cell border to cell border.

Cells are the leaves of the quadtree that snapping uses, so a cell has at most ``size`` nodes wherever they crowd. A node
with an edge to or from another cell is on its cell's border. Inside the cells, from every border node the ways to the
other border nodes of its cell are found once, all cells together, in as many rounds as the longest of these ways has
nodes; ways over a third border node are left to the overlay. What is found are edges with the nodes in between as an array, as
collapsed chains have them. A search over them and the edges between cells takes rounds for the cells that a route
crosses, not for its nodes. Where routes begin or end inside a cell, ``with_ends`` adds the ways between that end and
its cell's border. Distances are the whole map's but for the order of the sums.

It pays where borders are short against cells, as on maps. Where nodes have edges all over the map, all are on borders
and the overlay is the map itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.operators import snap
from roamgrid.operators.graph import reduced
from roamgrid.operators.routing import distances
from roamgrid.operators.walk import paths
from roamgrid.plans.lineage import written

SIZE = 256


@dataclass(frozen=True)
class Overlay:
    """inside(from_node_id, to_node_id, weight), the edges within cells; border(node); edges(from_node_id, to_node_id,
    weight, inner), those between cells and the ways between border nodes."""

    inside: DataFrame
    border: DataFrame
    edges: DataFrame


def cells(nodes: DataFrame, size: int = SIZE) -> DataFrame:
    """(node, cell) for the nodes(id, lat, lng) that have a place."""
    index = snap.build(nodes, size)
    if index is None:
        return nodes.where(F.lit(False)).select(F.col("id").alias("node"), F.lit("").alias("cell"))
    cell = F.concat_ws("/", "level", "x", "y").alias("cell")
    places = index.places.select(F.col("n_lat").alias("lat"), F.col("n_lng").alias("lng"), cell)
    return nodes.select(F.col("id").alias("node"), "lat", "lng").join(places, ["lat", "lng"]).select("node", "cell")


def _ways(starts: DataFrame, stops: DataFrame, inside: DataFrame) -> DataFrame:
    """(a, b, weight, inner): the least ways within cells from starts(node) to stops(node) that meet no other of both.

    So that a way ends where it comes to one of them, these nodes keep no edges out; a start leaves from a copy (odd
    numbers are copies, even ones nodes).
    """
    ends = starts.select("node").union(stops.select("node")).distinct()
    own = F.col("from_node_id") * 2
    to = (F.col("to_node_id") * 2).alias("to_node_id")
    through = inside.join(ends.withColumnRenamed("node", "from_node_id"), "from_node_id", "left_anti").select(own.alias("from_node_id"), to, "weight")
    out = inside.join(starts.select(F.col("node").alias("from_node_id")).distinct(), "from_node_id", "left_semi").select((own + 1).alias("from_node_id"), to, "weight")
    state, _ = distances(starts.select((F.col("node") * 2 + 1).alias("source")), through.unionByName(out))
    there = stops.select((F.col("node") * 2).alias("node")).distinct()
    found = written(state.join(there, "node", "left_semi").where("node <> source - 1"))
    ways = paths(found.select("source", "node"), state)
    inner = F.transform(F.slice("node_ids", F.lit(2), F.size("node_ids") - 2), lambda x: F.shiftright(x, 1))
    return found.join(ways, ["source", "node"]).select(F.shiftright("source", 1).alias("a"), F.shiftright("node", 1).alias("b"), F.col("dist").alias("weight"), inner.alias("inner"))


def _edges(ways: DataFrame, turned: bool = False) -> DataFrame:
    a, b, inner = ("b", "a", F.reverse("inner")) if turned else ("a", "b", F.col("inner"))
    return ways.select(F.col(a).alias("from_node_id"), F.col(b).alias("to_node_id"), "weight", inner.alias("inner"))


def _least(edges: DataFrame) -> DataFrame:
    """One of parallel edges: the least."""
    return edges.groupBy("from_node_id", "to_node_id").agg(F.min(F.struct("weight", "inner")).alias("x")).select("from_node_id", "to_node_id", "x.weight", "x.inner")


def build(nodes: DataFrame, edges: DataFrame, size: int = SIZE) -> Overlay:
    """Nodes without a place are cells of their own."""
    known = cells(nodes, size)
    at = lambda end: known.select(F.col("node").alias(f"{end}_node_id"), F.col("cell").alias(end))
    marked = reduced(edges).where("from_node_id <> to_node_id").join(at("from"), "from_node_id", "left").join(at("to"), "to_node_id", "left")
    marked = written(marked.select("from_node_id", "to_node_id", "weight", F.coalesce(F.col("from") == F.col("to"), F.lit(False)).alias("same")))
    inside = marked.where("same").drop("same")
    between = marked.where("not same").drop("same")
    border = written(between.select(F.explode(F.array("from_node_id", "to_node_id")).alias("node")).distinct())
    ways = _ways(border, border, inside)
    return Overlay(inside, border, written(_least(_edges(ways).unionByName(between.withColumn("inner", F.array().cast("array<bigint>"))))))


def with_ends(overlay: Overlay, ends: DataFrame) -> DataFrame:
    """The overlay's edges, and the ways between the ends(node) inside cells and the borders and other ends of these cells."""
    own = written(ends.select("node").distinct().join(overlay.border, "node", "left_anti"))
    stops = overlay.border.unionByName(own)
    turned = overlay.inside.select(F.col("to_node_id").alias("from_node_id"), F.col("from_node_id").alias("to_node_id"), "weight")
    more = _edges(_ways(own, stops, overlay.inside)).unionByName(_edges(_ways(own, stops, turned), turned=True))
    return written(_least(overlay.edges.unionByName(more)))
