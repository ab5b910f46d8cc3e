"""Collapse of chains: runs of nodes with exactly two neighbours become single edges that hold them as an array.

On a road map most nodes only bend a road. A search over the contracted edges takes a round for each junction, not for
each bend. Nodes that lie together on a road mostly have near numbers: chains whose nodes all fall into one block of numbers
are found within that block, without moving anything but the links into their blocks. Other chains are found by list ranking: every inner node has two darts, one for each way out; a dart points to the
next node's dart, and pointers are doubled until they stand at a junction, so a chain of n nodes takes log2(n) joins and
no chain is ever walked. Rings without a junction get one (their least node). A chain is cut behind every ``longest``
nodes, so that no array is unbounded.

Where requests begin or end inside a chain, ``split_at`` cuts that chain there; all other chains stay whole. ``expand``
puts the inner nodes back into paths. Distances are the uncontracted graph's but for the order of the sums.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roamgrid.plans.lineage import Scratch, scratch, written

LONGEST = 4096
#: Bits of a number within its block.
BLOCK = 15

_RUNS = "first long, second long, nodes array<long>, there array<double>, back array<double>, whole boolean"


@dataclass(frozen=True)
class Contracted:
    """chains(first, second, nodes, there, back) from junction to junction, with the weights of their steps in both ways
    (null where there is none: one more than nodes); rest(from_node_id, to_node_id, weight), the edges in no chain."""

    chains: DataFrame
    rest: DataFrame

    def edges(self) -> DataFrame:
        """(from_node_id, to_node_id, weight, inner): the least of parallel edges; inner nodes in order."""
        return _least(self.rest, self.chains)


def _whole(weights: Column) -> Column:
    """The weight of all steps, null if one is missing."""
    return F.aggregate(weights, F.lit(0.0), lambda t, w: t + w)


def _least(rest: DataFrame, chains: DataFrame) -> DataFrame:
    none = F.array().cast("array<bigint>")
    way = lambda a, b, weights, nodes: F.struct(F.col(a).alias("from_node_id"), F.col(b).alias("to_node_id"), _whole(F.col(weights)).alias("weight"), nodes.alias("inner"))
    both = F.explode(F.array(way("first", "second", "there", F.col("nodes")), way("second", "first", "back", F.reverse("nodes"))))
    ways = chains.select(both.alias("x")).select("x.*").where("weight is not null and from_node_id <> to_node_id")
    every = rest.withColumn("inner", none).unionByName(ways)
    return every.groupBy("from_node_id", "to_node_id").agg(F.min(F.struct("weight", "inner")).alias("x")).select("from_node_id", "to_node_id", "x.weight", "x.inner")


def _links(edges: DataFrame, keep: DataFrame | None, buckets: int) -> DataFrame:
    """(block, node, other, out, into, inner): every neighbour with the least weights to and from it, no self-loops; ``inner`` where a
    node has two and is not in keep(node). Rows lie by their block."""
    sound = edges.where((F.col("weight") < 1.7976931348623157e308) & (F.col("from_node_id") != F.col("to_node_id")))
    f, t, w, none = F.col("from_node_id"), F.col("to_node_id"), F.col("weight"), F.lit(None).cast("double")
    ends = F.explode(F.array(F.struct(f.alias("node"), t.alias("other"), w.alias("out"), none.alias("into")), F.struct(t.alias("node"), f.alias("other"), none.alias("out"), w.alias("into"))))
    rows = sound.select(ends.alias("x")).select("x.*").withColumn("stays", F.lit(False))
    if keep is not None:
        rows = rows.drop("stays").join(keep.select("node", F.lit(True).alias("stays")).distinct(), "node", "left")
    rows = rows.withColumn("block", F.shiftright("node", BLOCK)).repartition(buckets, "block")
    links = rows.groupBy("block", "node", "other").agg(F.min("out").alias("out"), F.min("into").alias("into"), F.max("stays").alias("stays"))
    number = F.count("*").over(Window.partitionBy("block", "node"))
    return links.select("block", "node", "other", "out", "into", ((number == 2) & ~F.coalesce("stays", F.lit(False))).alias("inner"))


def _runs(rows: pa.Table, longest: int) -> pa.Table:
    """The runs of a block's inner nodes, from their rows(node, other, out, into), two for each; ``whole`` is false for rings and for what
    is longer than ``longest`` (nodes only). Pointers are doubled as in ``_ranked``."""
    order = np.lexsort((rows["other"].to_numpy(), rows["node"].to_numpy()))
    node, other, out, into = (rows[c].to_numpy(zero_copy_only=False)[order] for c in ("node", "other", "out", "into"))
    out, into = out.astype(float), into.astype(float)
    ids, number = node[::2], len(node) // 2
    # dart 2 i + s stands at node i and looks to its neighbour s
    at = np.minimum(np.searchsorted(ids, other), number - 1)
    goes = ids[at] == other
    # at the next node it looks to the neighbour that it does not come from
    ahead = np.where(goes, 2 * at + (other[2 * at] == node), np.arange(2 * number))
    rank = goes.astype(np.int64)
    for _ in range(number.bit_length() + 1):
        rank, ahead = rank + rank[ahead], ahead[ahead]
    ring = goes[ahead]
    # the end with the lesser (junction, node before it) comes first
    p, q = ahead[::2], ahead[1::2]
    turned = (other[p] > other[q]) | ((other[p] == other[q]) & (node[p] > node[q]))
    dart = 2 * np.arange(number) + turned  # looks to the first end
    key, place = ahead[dart], rank[dart]
    broken = ring[::2] | ring[1::2]
    key = np.where(broken, -1, key)
    order = np.lexsort((place, key))
    dart, key, broken = dart[order], key[order], broken[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, number))
    whole = ~broken[starts] & (sizes <= longest)
    final = dart[starts + sizes - 1] ^ 1
    # one weight more than nodes: behind each run's last node the step to the second end
    weights = lambda own, last: np.insert(own[dart], starts + sizes, last[final])
    lists = lambda values, more: pa.ListArray.from_arrays(pa.array(np.append(starts, number) + np.arange(len(starts) + 1) * more, pa.int32()), values)
    real = lambda x: pa.array(x, mask=np.isnan(x))
    return pa.table({"first": other[dart[starts]], "second": other[final], "nodes": lists(pa.array(node[dart]), 0), "there": lists(real(weights(into, out)), 1), "back": lists(real(weights(out, into)), 1), "whole": whole})


def _ranked(tables: Scratch, darts: DataFrame, inner: DataFrame) -> DataFrame:
    """Darts(node, back, ahead, out, into) with ``end`` (the junction ahead), ``last`` (the node before it) and ``rank``
    (nodes up to there, the dart's own counted); ``end`` is null in rings, where ``least`` is the ring's least node.

    A doubling moves and writes the darts that have not ended; those that have stay where they were written."""
    ahead = darts.join(inner.select(F.col("node").alias("ahead"), F.lit(True).alias("goes_on")), "ahead", "left")
    goes = F.col("goes_on").isNotNull()
    names = ["at", "at_back", "end", "last", "rank", "least"]
    state, counts = tables.keep_counted(ahead.select("node", "back", F.when(goes, F.col("ahead")).alias("at"), F.when(goes, F.col("node")).alias("at_back"), F.when(~goes, F.col("ahead")).alias("end"), F.col("node").alias("last"), F.lit(1).cast("long").alias("rank"), F.col("node").alias("least")), "node", "back", moves=F.col("at").isNotNull())
    total, rounds, parts = counts["rows"], 0, [state]
    # after this many doublings a pointer has gone over more darts than there are: what has not ended is a ring
    while rounds <= total.bit_length() and counts["moves"]:
        moved = state.where("at is not null")
        for i, part in enumerate(parts):  # of the last part all darts, of those before the ended ones: each dart is in one
            own = part if part is state else part.where("at is null")
            moved = moved.join(own.select(F.col("node").alias("at"), F.col("back").alias("at_back"), F.struct(*names).alias(f"f{i}")), ["at", "at_back"], "left")
        far = F.coalesce(*(F.col(f"f{i}") for i in range(len(parts))))
        moved = moved.select("node", "back", "rank", "least", far.alias("f")).select("node", "back", "f.at", "f.at_back", "f.end", "f.last", (F.col("rank") + F.col("f.rank")).alias("rank"), F.least("least", "f.least").alias("least"))
        state, counts = tables.keep_counted(moved, "node", "back", moves=F.col("at").isNotNull())
        parts.append(state)
        rounds += 1
    whole = reduce(DataFrame.unionByName, (p if p is state else p.where("at is null") for p in parts))
    return tables.keep(darts.join(whole.select("node", "back", "end", "last", "rank", "least"), ["node", "back"]), "node")


def contract(edges: DataFrame, keep: DataFrame | None = None, longest: int = LONGEST) -> Contracted:
    """Chains of the graph; nodes of keep(node) stay junctions."""
    with scratch(edges.sparkSession) as tables:
        return _contract(tables, edges, keep, longest)


def _contract(tables: Scratch, edges: DataFrame, keep: DataFrame | None, longest: int) -> Contracted:
    links = tables.keep(_links(edges, keep, tables.buckets), "block", lies=True)
    runs = links.where("inner").select("block", "node", "other", "out", "into").groupBy("block").applyInArrow(lambda rows: _runs(rows, longest), _RUNS)
    runs = tables.keep(runs.withColumn("head", F.element_at("nodes", 1)))
    own = runs.select(F.explode("nodes").alias("node"))
    # a run that ends at another block's inner node is a part of a chain
    ends = runs.where("whole").select("head", F.explode(F.array("first", "second")).alias("node"))
    parts = tables.keep(ends.join(own, "node", "left_semi").select("head").union(runs.where("not whole").select("head")).distinct())
    chains = runs.join(parts, "head", "left_anti").select("first", "second", "nodes", "there", "back")
    at = lambda rows, end: rows.select(F.col("node").alias(f"{end}_node_id"))
    edge = lambda rows: rows.where("out is not null").select(F.col("node").alias("from_node_id"), F.col("other").alias("to_node_id"), F.col("out").alias("weight"))
    if parts.isEmpty():
        return Contracted(written(chains), written(edge(links.where("not inner")).join(at(own, "to"), "to_node_id", "left_anti")))
    inner = tables.keep(runs.join(parts, "head", "left_semi").select(F.explode("nodes").alias("node")), "node")
    more, stays = _crossing(tables, tables.keep(links.where("inner").drop("block", "inner").join(inner, "node", "left_semi"), "node"), inner, longest)
    stays = tables.keep(stays)
    kept = own.join(stays, "node", "left_anti")
    rest = edge(links.where("not inner")).unionByName(edge(links.where("inner").join(stays, "node", "left_semi")))
    return Contracted(written(chains.unionByName(more)), written(rest.join(at(kept, "to"), "to_node_id", "left_anti")))


def _crossing(tables: Scratch, own: DataFrame, inner: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """The chains of the inner(node) nodes, and those(node) of them that are junctions after all, by list ranking over own(node, other, out,
    into)."""
    # a dart looks from one neighbour (back) to the other (ahead)
    darts = own.alias("a").join(own.alias("b"), F.expr("a.node = b.node and a.other <> b.other")).select("a.node", F.col("b.other").alias("back"), F.col("a.other").alias("ahead"), "a.out", "a.into")
    darts = tables.keep(darts, "node", "back")
    ranked = _ranked(tables, darts, inner)
    opened = tables.keep(ranked.where("end is null").select(F.col("least").alias("node")).distinct())
    if not opened.isEmpty():
        inner = tables.keep(inner.join(opened, "node", "left_anti"), "node")
        ranked = _ranked(tables, darts.join(inner, "node", "left_semi"), inner)
    side = lambda x: ranked.select("node", F.struct("end", "last").alias(f"{x}_key"), "back", F.col("rank").alias(f"{x}_rank"), F.col("out").alias(f"{x}_out"), F.col("into").alias(f"{x}_into"), F.col("ahead").alias(f"{x}_ahead"))
    # the two darts of a node, the one towards the lesser end first
    both = side("p").join(side("q").withColumnRenamed("back", "q_back"), "node").where("p_ahead = q_back and p_key < q_key").drop("back", "q_back")
    # every ``longest``-th node is a junction again: it ends one piece and begins the next
    both = both.withColumns({"piece": F.floor((F.col("p_rank") - 1) / (longest + 1)), "stays": (F.col("p_rank") % (longest + 1) == 0)})
    member = F.struct(F.col("p_rank").alias("rank"), "node", F.col("p_into").alias("there"), F.col("p_out").alias("back"), F.col("q_ahead").alias("next"), F.col("q_out").alias("out"), F.col("q_into").alias("into"), F.col("p_ahead").alias("before"))
    pieces = both.where("not stays").groupBy("p_key", "q_key", "piece").agg(F.sort_array(F.collect_list(member)).alias("m"))
    last = F.element_at("m", -1)
    field = lambda name: F.transform("m", lambda x: x[name])
    chains = pieces.select(
        F.element_at("m", 1)["before"].alias("first"), last["next"].alias("second"), field("node").alias("nodes"),
        F.concat(field("there"), F.array(last["out"])).alias("there"), F.concat(field("back"), F.array(last["into"])).alias("back"),
    )
    return chains, opened.unionByName(both.where("stays").select("node"))


def split_at(contracted: Contracted, ends: DataFrame) -> Contracted:
    """The same with chains cut at the inner nodes that are in ends(node)."""
    member = contracted.chains.select("first", "second", F.element_at("nodes", 1).alias("head"), F.posexplode("nodes").alias("place", "node"))
    hit = member.join(ends.select("node").distinct(), "node", "left_semi").groupBy("first", "second", "head").agg(F.sort_array(F.collect_list(F.col("place") + 1)).alias("cuts"))
    chains = contracted.chains.withColumn("head", F.element_at("nodes", 1)).join(hit, ["first", "second", "head"], "left").drop("head")
    # places 0 and n + 1 are the junctions
    marks = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("nodes") + 1))
    node = lambda i: F.when(i == 0, F.col("first")).when(i == F.size("nodes") + 1, F.col("second")).otherwise(F.get("nodes", i - 1))
    marked = chains.withColumn("marks", marks)
    pairs = F.transform(F.slice("marks", F.lit(1), F.size("marks") - 1), lambda a, i: F.struct(a.alias("a"), F.get("marks", i + 1).alias("b")))
    parts = marked.select("first", "second", "nodes", "there", "back", F.explode(pairs).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    cut = lambda c: F.slice(c, a + 1, b - a)
    parts = parts.select(node(a).alias("first"), node(b).alias("second"), F.slice("nodes", a + 1, b - a - 1).alias("nodes"), cut("there").alias("there"), cut("back").alias("back"))
    return Contracted(parts, contracted.rest)


def expand(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes(request_id, node_ids, ...) over contracted ``edges`` with the inner nodes put back."""
    steps = F.transform(F.slice("node_ids", F.lit(1), F.greatest(F.size("node_ids") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("from_node_id"), F.get("node_ids", i + 1).alias("to_node_id")))
    each = routes.select("request_id", F.posexplode(steps).alias("pos", "s")).select("request_id", "pos", "s.*").join(edges.select("from_node_id", "to_node_id", "inner"), ["from_node_id", "to_node_id"])
    piece = F.struct("pos", F.concat("inner", F.array("to_node_id")).alias("nodes"))
    grown = each.groupBy("request_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["nodes"])).alias("more"))
    return routes.join(grown, "request_id", "left").withColumn("node_ids", F.concat(F.slice("node_ids", 1, 1), F.coalesce("more", F.array().cast("array<bigint>")))).drop("more")
