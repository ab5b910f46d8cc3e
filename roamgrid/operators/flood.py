"""Distances from a few sources to all nodes of a large map, by rounds over blocks of nodes.

Nodes are dealt to blocks of a bounded number of edges. A block's edges are one row, sorted by where they lead, and so is
what is known of its nodes: an array of distances and one of predecessors, a column for each source. In a round, every
block relaxes the edges of its nodes that improved, for all sources together, and hands on the least offer for each node
and source only, a row for each block that it leads to; then every block takes the least of its offers. Rows that are moved
are so as few as the blocks' pairs, and edges never move. No task holds more than a few blocks' arrays.

Results are those of ``routing.distances``, which is for many sources that reach few nodes each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.operators.graph import reduced
from roamgrid.plans.lineage import Scratch, scratch, written

#: Edges times sources of a block; sources that are flooded together.
BLOCK, TOGETHER = 4_000_000, 16
FARTHEST = 1.7976931348623157e308
NOBODY = np.iinfo(np.int64).max

_EDGES = "block int, part int, node binary, next binary, next_block binary, weight binary"
_STATE = "block int, node binary, dist binary, prev binary, open binary, goal binary, n_open long, missing array<long>, farthest array<double>"
_OFFERS = "block int, node binary, source binary, dist binary, prev binary"


def _block(node: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(blocks)).cast("int")


def _table(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split(" ") for field in text.split(", "))])


def _array(row: dict, name: str, kind: type | str = np.int64) -> np.ndarray:
    return np.frombuffer(row[name], dtype=kind)


def _packed(edges: pa.Table) -> pa.Table:
    """A block's edges as one row, by the block and node that they lead to."""
    node, to, block, weight = (edges[c].to_numpy() for c in ("node", "next", "next_block", "weight"))
    order = np.lexsort((node, to, block))
    row = {"block": edges["block"][0].as_py(), "part": edges["part"][0].as_py(), "node": node[order].tobytes(), "next": to[order].tobytes(), "next_block": block[order].tobytes(), "weight": weight[order].tobytes()}
    return _table(_schema(_EDGES), [row])


def _known(block: int, node: np.ndarray, dist: np.ndarray, prev: np.ndarray, opened: np.ndarray, goal: np.ndarray) -> pa.Table:
    """A block's state; ``missing`` goals and the ``farthest`` reached one, by source."""
    reached = np.isfinite(dist)
    farthest = np.where(goal & reached, dist, 0.0).max(axis=0, initial=0.0)
    row = {"block": block, "node": node.tobytes(), "dist": dist.tobytes(), "prev": prev.tobytes(), "open": opened.tobytes(), "goal": goal.tobytes()}
    return _table(_schema(_STATE), [row | {"n_open": int(opened.sum()), "missing": (goal & ~reached).sum(axis=0).tolist(), "farthest": farthest.tolist()}])


def _begin(rows: pa.Table, sources: np.ndarray) -> pa.Table:
    """The state before the first round, from rows(block, node, source, start): sources and goals."""
    node, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
    column, start = np.searchsorted(sources, rows["source"].to_numpy()), rows["start"].to_numpy(zero_copy_only=False)
    shape = (len(node), len(sources))
    dist, goal = np.full(shape, np.inf), np.zeros(shape, dtype=bool)
    dist[at[start], column[start]] = 0.0
    goal[at[~start], column[~start]] = True
    return _known(rows["block"][0].as_py(), node, dist, np.full(shape, NOBODY), dist == 0.0, goal)


def _relax(edges: pa.Table, state: pa.Table, bounds: np.ndarray) -> pa.Table:
    """The least offers of a block, a row for each block that they go to."""
    schema, width = _schema(_OFFERS), len(bounds)
    if not len(edges) or not len(state):
        return _table(schema, [])
    own, known = edges.to_pylist()[0], state.to_pylist()[0]
    nodes, dist = _array(known, "node"), _array(known, "dist", float).reshape(-1, width)
    moving = _array(known, "open", bool).reshape(-1, width) & (dist < bounds)
    node = _array(own, "node")
    at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
    used = np.flatnonzero((nodes[at] == node) & moving.any(axis=1)[at])
    if not len(used):
        return _table(schema, [])
    node, at, to, block = node[used], at[used], _array(own, "next")[used], _array(own, "next_block", np.int32)[used]
    offers = np.where(moving, dist, np.inf)[at] + _array(own, "weight", float)[used][:, None]
    starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(to))))
    best = np.minimum.reduceat(offers, starts, axis=0)
    # of equal ones the smallest predecessor
    via = np.minimum.reduceat(np.where(offers == best[group], node[:, None], NOBODY), starts, axis=0)
    to, block = to[starts], block[starts]
    ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
    rows, begin = [], 0
    for end in ends:
        i, source = np.nonzero(best[begin:end] < FARTHEST)
        if len(i):
            i += begin
            rows.append({"block": int(block[begin]), "node": to[i].tobytes(), "source": source.astype(np.int16).tobytes(), "dist": best[i, source].tobytes(), "prev": via[i, source].tobytes()})
        begin = end
    return _table(schema, rows)


def _relaxed(bounds: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda edges, state: _relax(edges, state, bounds)


def _take(offers: pa.Table, state: pa.Table, width: int) -> pa.Table:
    """A block's state after its offers."""
    offers, known = offers.to_pylist(), state.to_pylist()
    block = (known or offers)[0]["block"]
    old = _array(known[0], "node") if known else np.zeros(0, dtype=np.int64)
    node = np.unique(np.concatenate([old, *(_array(row, "node") for row in offers)]))
    shape = (len(node), width)
    dist, prev, goal = np.full(shape, np.inf), np.full(shape, NOBODY), np.zeros(shape, dtype=bool)
    if known:
        at = np.searchsorted(node, old)
        for whole, name, kind in ((dist, "dist", float), (prev, "prev", np.int64), (goal, "goal", bool)):
            whole[at] = _array(known[0], name, kind).reshape(-1, width)
    best, via = np.full(dist.size, np.inf), np.full(dist.size, NOBODY)
    for row in offers:  # a row has one offer for each node and source
        key = np.searchsorted(node, _array(row, "node")) * width + _array(row, "source", np.int16)
        d, p = _array(row, "dist", float), _array(row, "prev")
        nearer = (d < best[key]) | ((d == best[key]) & (p < via[key]))
        best[key[nearer]], via[key[nearer]] = d[nearer], p[nearer]
    best, via = best.reshape(shape), via.reshape(shape)
    improved = best < dist
    dist[improved], prev[improved] = best[improved], via[improved]
    return _known(block, node, dist, prev, improved, goal)


def _rows(state: pa.Table, sources: np.ndarray) -> pa.Table:
    """(source, node, dist, prev) of a block's nodes that are reached; a source has no prev."""
    known = state.to_pylist()[0]
    nodes, dist = _array(known, "node"), _array(known, "dist", float).reshape(-1, len(sources))
    prev = _array(known, "prev").reshape(dist.shape)
    i, column = np.nonzero(np.isfinite(dist))
    via = prev[i, column]
    return pa.table({"source": sources[column], "node": nodes[i], "dist": dist[i, column], "prev": pa.array(via, mask=via == NOBODY)})


class Blocks:
    """A map's edges(from_node_id, to_node_id, weight) in blocks, for floods of at most ``width`` sources together."""

    def __init__(self, tables: Scratch, edges: DataFrame, width: int, size: int = BLOCK):
        self.tables = tables
        graph, counts = tables.keep_counted(reduced(edges).select(F.col("from_node_id").alias("node"), F.col("to_node_id").alias("next"), "weight"))
        held = max(1, size // width)
        self.number = max(tables.buckets, -(-counts["rows"] // held))
        graph = graph.withColumn("block", _block("node", self.number))
        most = graph.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        # a node with very many edges: its block's edges lie in parts
        self.parts = -(-most // (4 * held)) or 1
        graph = graph.withColumns({"next_block": _block("next", self.number), "part": F.pmod(F.xxhash64("next", F.lit(1)), F.lit(self.parts)).cast("int")})
        self.edges = tables.keep(graph.groupBy("block", "part").applyInArrow(_packed, _EDGES), "block", "part", lies=True)
        tables.drop(graph)

    def flood(self, sources: list[int], targets: DataFrame | None = None, begin: Callable[[int], list[int]] = lambda x: [x]) -> tuple[DataFrame, int]:
        """(source, node, dist, prev) of all nodes reached, and the number of rounds; targets(source, node) as in ``routing.distances``.
        A source's flood begins at the nodes that ``begin`` has for it."""
        spark, tables = self.edges.sparkSession, self.tables
        known = np.array(sorted(set(sources)), dtype=np.int64)
        width = len(known)
        columns = range(width)
        starts = spark.createDataFrame([(int(x), node, True) for x in known for node in begin(int(x))], "source long, node long, start boolean")
        if targets is not None:
            starts = starts.unionByName(targets.select("source", "node").distinct().withColumn("start", F.lit(False)))
        begun = starts.withColumn("block", _block("node", self.number)).groupBy("block").applyInArrow(lambda rows: _begin(rows, known), _STATE)

        def kept(rows: DataFrame) -> tuple[DataFrame, dict]:
            each = {f"{name}_{i}": f(F.get(name, F.lit(i))) for i in columns for f, name in ((F.sum, "missing"), (F.max, "farthest"))}
            return tables.keep_observed(rows, "block", lies=True, values={"open": F.sum("n_open")} | each)

        state, counts = kept(begun)
        rounds = 0
        while counts["open"]:
            near = lambda i: counts[f"farthest_{i}"] if targets is not None and not counts[f"missing_{i}"] else np.inf
            bounds = np.array([near(i) for i in columns])
            moving = state.where("n_open > 0").select("block", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"), "node", "dist", "open")
            offers = self.edges.groupBy("block", "part").cogroup(moving.groupBy("block", "part")).applyInArrow(_relaxed(bounds), _OFFERS)
            after, counts = kept(offers.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(lambda rows, own: _take(rows, own, width), _STATE))
            tables.drop(state)
            state = after
            rounds += 1
        rows = state.groupBy("block").applyInArrow(lambda own: _rows(own, known), "source long, node long, dist double, prev long")
        return written(rows), rounds


def flood(sources: list[int], edges: DataFrame, targets: DataFrame | None = None, size: int = BLOCK, begin: Callable[[int], list[int]] = lambda x: [x]) -> DataFrame:
    """(source, node, dist, prev) of all nodes reached from the sources, ``TOGETHER`` of them at a time; ``begin`` as in ``Blocks.flood``."""
    ordered = sorted(set(sources))
    if not ordered:
        return edges.sparkSession.createDataFrame([], "source long, node long, dist double, prev long")
    with scratch(edges.sparkSession) as tables:
        blocks = Blocks(tables, edges, min(TOGETHER, len(ordered)), size)
        found = None
        for k in range(0, len(ordered), TOGETHER):
            some = ordered[k : k + TOGETHER]
            own = blocks.flood(some, targets.where(F.col("source").isin(some)) if targets is not None else None, begin)[0]
            found = own if found is None else found.unionByName(own)
        return found
