"""Distances on maps of many hops, over nested cells: as many rounds as the map has levels, not as its ways have nodes.

Nodes are numbered along a curve that keeps near places together; ``size`` consecutive ones are a cell, and on the next
level some consecutive cells are one. Level by level, what lies within a cell gives way to the shortest ways between the
cell's border nodes (those with an edge to another cell), so the next level's graph has the same distances between fewer
nodes. When that no longer shrinks it, the rest is flooded, and the distances go down again, a level at a time: a cell's
nodes are reached from its borders. Cells are worked on apart, by as many tasks as there are partitions.

It pays where borders are short, as on maps; where they are not, the first level is the last and all is flooded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.operators.graph import reduced
from roamgrid.operators.ingest import dense_ids
from roamgrid.operators.routing import distances
from roamgrid.plans.lineage import written

#: Nodes of a cell on the first level, and a fourth of what any cell may hold; the share of a level's nodes below which another level is worth it; bits of a place.
SIZE, SHARE, BITS = 384, 0.75, 26


def _spread(x):
    """A zero behind every bit of a number of up to 31 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def places(nodes: DataFrame) -> DataFrame:
    """(node, place): the nodes(id, lat, lng) numbered from 0 along the curve."""
    box = nodes.agg(F.min("lat"), F.min("lng"), F.max("lat"), F.max("lng")).first()
    if box[0] is None:
        return nodes.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("place"))
    side = max(box[2] - box[0], box[3] - box[1], 1e-9) * (1 + 1e-9)
    part = lambda c, start: _spread(F.floor((F.col(c) - F.lit(start)) * F.lit((1 << BITS) / side)).cast("long"))
    curve = F.shiftleft(part("lat", box[0]), 1).bitwiseOR(part("lng", box[1]))
    rows = dense_ids(nodes.select(F.col("id").alias("node"), curve.alias("curve")), "curve", "node")
    return rows.select("node", (F.col("id") - 1).alias("place"))


def _matrix(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cell's nodes and the least weights of its edges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    d = np.full((len(ids), len(ids)), np.inf)
    np.minimum.at(d, (at[: len(a)], at[len(a) :]), w)
    np.fill_diagonal(d, 0.0)
    return ids, d


def _between(rows: pd.DataFrame) -> pd.DataFrame:
    """A cell's edges(a, b, weight, a_stays, b_stays): the shortest ways within it between the nodes that stay."""
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    ids, d = _matrix(a, b, rows["weight"].to_numpy())
    stay = np.isin(ids, np.concatenate([a[rows["a_stays"]], b[rows["b_stays"]]]))
    for k in np.flatnonzero(~stay):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    ids, d = ids[stay], d[np.ix_(stay, stay)]
    useful = np.isfinite(d)
    np.fill_diagonal(useful, False)
    # a way over a third node that stays, if both halves are truly shorter, is found by its halves
    for k in range(len(ids)):
        there, back = d[:, k, None], d[None, k, :]
        useful &= ~((there + back <= d) & (there < d) & (back < d))
    i, j = np.nonzero(useful)
    return pd.DataFrame({"a": ids[i], "b": ids[j], "weight": d[i, j]})


def _reached(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Distances of a cell's nodes from those of them that are known(node, source, dist)."""
    ids, d = _matrix(edges["a"].to_numpy(), edges["b"].to_numpy(), edges["weight"].to_numpy()) if len(edges) else (np.unique(known["node"]), None)
    out = []
    for source, own in known.groupby("source"):
        nodes, dist = own["node"].to_numpy(), own["dist"].to_numpy()
        if d is None:
            out.append(pd.DataFrame({"source": source, "node": nodes, "dist": dist}))
            continue
        best = np.full(len(ids), np.inf)
        at = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
        met = ids[at] == nodes
        best[at[met]] = dist[met]
        while True:
            nearer = np.minimum(best, (best[:, None] + d).min(axis=0))
            if not (nearer < best).any():
                break
            best = nearer
        reached = np.isfinite(best)
        out.append(pd.DataFrame({"source": source, "node": np.concatenate([ids[reached], nodes[~met]]), "dist": np.concatenate([best[reached], dist[~met]])}))
    return pd.concat(out) if out else pd.DataFrame({"source": [], "node": [], "dist": []}).astype({"source": "int64", "node": "int64", "dist": "float64"})


def nested_distances(sources: DataFrame, nodes: DataFrame, edges: DataFrame, size: int = SIZE) -> DataFrame:
    """(source, node, dist) as ``routing.distances`` has them, for edges between nodes(id, lat, lng) that have places.

    Edges of nodes without a place stay as they are. Distances are the same but for the order of the sums."""
    at = written(places(nodes.where("lat is not null and lng is not null")))
    starts = written(sources.select("source").distinct())
    place = lambda end: at.select(F.col("node").alias(end), F.col("place").alias(f"{end}_place"))
    sound = reduced(edges).where("from_node_id <> to_node_id").select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("b"), "weight")
    graph = written(sound.join(place("a"), "a", "left").join(place("b"), "b", "left"))
    width, levels = size, []
    number = None
    while True:
        cell = lambda end, width=width: F.expr(f"{end}_place div {width}")
        same = F.coalesce(cell("a") == cell("b"), F.lit(False))
        between = graph.where(~same)
        fixed = starts.select(F.col("source").alias("node")).union(between.select("a")).union(between.select("b")).distinct()
        stays = written(fixed.select("node", F.lit(True).alias("stays")))
        flag = lambda end: stays.select(F.col("node").alias(end), F.col("stays").alias(f"{end}_stays"))
        marked = graph.where(same).withColumn("cell", cell("a")).join(flag("a"), "a", "left").join(flag("b"), "b", "left")
        inside = written(marked.fillna(False, ["a_stays", "b_stays"]))
        if number is None:
            number = graph.select("a").union(graph.select("b")).distinct().count()
        left = stays.count()
        if inside.isEmpty() or left > SHARE * number:
            break
        ways = inside.groupBy("cell").applyInPandas(lambda rows: _between(rows), "a long, b long, weight double")
        levels.append(inside)
        own = ways.join(place("a"), "a").join(place("b"), "b").select(*graph.columns)
        graph = written(between.select(*own.columns).unionByName(own))
        number = left
        # as many cells in one as keeps the largest within the size
        ends = graph.select(F.col("a").alias("node"), F.col("a_place").alias("place")).union(graph.select("b", "b_place")).where("place is not null").distinct()
        held = ends.groupBy(F.expr(f"place div {width}").alias("cell")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if not held or held > 2 * size:  # no cell may hold more than four times the size
            break
        width *= max(2, size // held)
    known = distances(starts, graph.select(F.col("a").alias("from_node_id"), F.col("b").alias("to_node_id"), "weight"))[0].select("source", "node", "dist")
    for inside in reversed(levels):
        cells = inside.select(F.col("a").alias("node"), F.col("cell").alias("own")).union(inside.select("b", "cell")).distinct()
        seeds = known.join(cells, "node")
        down = inside.select("cell", "a", "b", "weight").groupBy("cell").cogroup(seeds.groupBy("own"))
        met = down.applyInPandas(lambda rows, own: _reached(rows, own), "source long, node long, dist double")
        known = written(known.unionByName(met).groupBy("source", "node").agg(F.min("dist").alias("dist")))
    return known
