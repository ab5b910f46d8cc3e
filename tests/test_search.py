"""Searches against Dijkstra's algorithm on small random graphs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from roamgrid.operators import contract, landmarks, nested, overlay, pairs, routing, walk


def dijkstra(edges, source):
    out = {}
    for f, t, w in edges:
        out.setdefault(f, []).append((t, w))
    dist, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in out.get(u, ()):
            if d + w < dist.get(v, math.inf):
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def frame(spark, edges):
    return spark.createDataFrame([(f, t, float(w)) for f, t, w in edges], "from_node_id long, to_node_id long, weight double")


def road(seed, junctions=9, longest=6, oneway=0.3):
    """Chains between random junctions, some one-way, some dead ends, loops and parallel chains, and a ring of its own."""
    draw, edges, n = random.Random(seed), [], junctions
    for _ in range(2 * junctions):
        a, b, k = draw.randrange(junctions), draw.randrange(junctions), draw.randrange(longest)
        way = [a, *range(n, n + k), b if draw.random() > 0.15 else n + k]
        n += k + 1
        single = draw.random() < oneway
        for x, y in zip(way, way[1:]):
            w = draw.randint(1, 9)
            edges.append((x, y, w))
            if not single:
                edges.append((y, x, draw.choice([w, w + 1])))
    ring = list(range(n, n + 5))
    edges += [(a, b, 2) for a, b in zip(ring, ring[1:] + ring[:1])]
    return edges, n + 5


def length(edges, way):
    least = {}
    for f, t, w in edges:
        least[f, t] = min(w, least.get((f, t), math.inf))
    return sum(least[a, b] for a, b in zip(way, way[1:]))


def check(edges, found, asked):
    """Every route has the least distance, is a way of the graph, and none is missing."""
    got = {(r["source"], r["target"]): r for r in found}
    reach = {s: dijkstra(edges, s) for s in {s for s, _ in asked}}
    assert set(got) == {(s, t) for s, t in asked if t in reach[s]}
    for (s, t), r in got.items():
        way = r["node_ids"]
        assert r["distance"] == reach[s][t] == length(edges, way) and way[0] == s and way[-1] == t


@pytest.mark.parametrize(("seed", "longest"), [(1, 4096), (2, 3)])
def test_collapsed_chains_keep_all_distances(spark, seed, longest):
    edges, n = road(seed)
    known = sorted({x for f, t, _ in edges for x in (f, t)})
    shape = contract.contract(frame(spark, edges), longest=longest)
    rows = shape.chains.collect()
    assert all(len(r["nodes"]) <= longest and len(r["there"]) == len(r["back"]) == len(r["nodes"]) + 1 for r in rows)
    inner = [x for r in rows for x in r["nodes"]]
    assert len(inner) == len(set(inner)) > 8 and (longest < 4096 or len(inner) > len(known) / 3)
    # junctions alone: the same distances
    short = [(r["from_node_id"], r["to_node_id"], r["weight"]) for r in shape.edges().collect()]
    left = [x for x in known if x not in set(inner)]
    for s in left:
        whole, less = dijkstra(edges, s), dijkstra(short, s)
        assert {x: d for x, d in whole.items() if x in left} == {x: d for x, d in less.items() if x in left}
    # ends inside chains
    draw = random.Random(seed)
    asked = sorted({(draw.choice(known), draw.choice(known)) for _ in range(12)} | {(inner[0], inner[1]), (inner[1], inner[0])})
    ends = spark.createDataFrame([(x,) for pair in asked for x in pair], "node long")
    cut = contract.split_at(shape, ends).edges()
    routes = pairs.meet(spark.createDataFrame(asked, "source long, target long"), cut).withColumn("request_id", F.monotonically_increasing_id())
    check(edges, contract.expand(routes, cut).collect(), asked)


def test_collapse_without_chains(spark):
    shape = contract.contract(frame(spark, []))
    assert shape.chains.count() == shape.rest.count() == shape.edges().count() == 0
    shape = contract.contract(frame(spark, [(1, 1, 5), (1, 2, 3), (1, 2, 2)]))
    assert shape.chains.count() == 0 and [tuple(r)[:3] for r in shape.edges().collect()] == [(1, 2, 2.0)]


def test_kept_nodes_stay_junctions(spark):
    line = [(i, i + 1, 1) for i in range(40)] + [(i + 1, i, 1) for i in range(40)]
    keep = spark.createDataFrame([(7,), (20,)], "node long")
    shape = contract.contract(frame(spark, line), keep)
    assert sorted((r["first"], r["second"], len(r["nodes"])) for r in shape.chains.withColumns({"first": F.least("first", "second"), "second": F.greatest("first", "second")}).collect()) == [(0, 7, 6), (7, 20, 12), (20, 40, 19)]


def lattice(width, height, draw):
    edges = []
    for x in range(width):
        for y in range(height):
            for a, b in ((1, 0), (0, 1)):
                if x + a < width and y + b < height:
                    w = draw.randint(1, 9)
                    edges += [(x * height + y, (x + a) * height + y + b, w), ((x + a) * height + y + b, x * height + y, w)]
    return edges


@pytest.mark.parametrize(("seed", "indexed"), [(4, False), (5, True)])
def test_pairs(spark, seed, indexed):
    draw = random.Random(seed)
    edges, n = road(seed) if seed == 4 else ([*lattice(5, 5, draw), (100, 101, 1), (101, 100, 1), (3, 200, 4), (201, 5, 4)], 25)
    asked = sorted({(draw.randrange(n), draw.randrange(n)) for _ in range(40)} | {(3, 3), (3, 100), (100, 3), (100, 101), (3, 200), (200, 3), (201, 3), (201, 200), (900, 1)})
    index = landmarks.table(frame(spark, edges), [0, 3, 5]) if indexed else None
    found = pairs.meet(spark.createDataFrame(asked, "source long, target long"), frame(spark, edges), index).collect()
    if not seed == 4:
        assert len(found) > 8
    check(edges, found, asked)


def test_no_pairs(spark):
    assert pairs.meet(spark.createDataFrame([], "source long, target long"), frame(spark, [(1, 2, 1)])).collect() == []
    assert pairs.meet(spark.createDataFrame([(1, 2)], "source long, target long"), frame(spark, [])).collect() == []


def test_bounds_hold(spark):
    edges, n = road(6)
    known = sorted({x for f, t, _ in edges for x in (f, t)})
    index = landmarks.table(frame(spark, edges), [0, 1, known[-1]])
    asked = spark.createDataFrame([(a, b) for a in known[::3] for b in known[::4]], "source long, target long")
    for r in landmarks.bounded(asked, index).collect():
        d = dijkstra(edges, r["source"]).get(r["target"], math.inf)
        assert r["bound"] is None or d <= r["bound"]
    both = asked.join(index.select(F.col("node").alias("source"), F.col("out").alias("ao"), F.col("into").alias("ai")), "source").join(index.select(F.col("node").alias("target"), F.col("out").alias("bo"), F.col("into").alias("bi")), "target")
    for r in both.select("source", "target", landmarks.at_least("ao", "ai", "bo", "bi").alias("least")).collect():
        assert r["least"] <= dijkstra(edges, r["source"]).get(r["target"], math.inf)


def test_a_target_out_of_reach_makes_no_flood(spark, monkeypatch):
    """One source, ten near targets and one on a one-way street that only leads away from it: that one leaves before the search."""
    edges = lattice(12, 12, random.Random(7)) + [(9000, 0, 1)]
    index = landmarks.table(frame(spark, edges), [0, 11, 143])
    near = [1, 2, 12, 13, 14, 24, 25, 3, 26, 36]
    nodes = spark.createDataFrame([(i,) for i in [*range(144), 9000]], "id long")
    requests = spark.createDataFrame([(i, 0, t) for i, t in enumerate([*near, 9000])], "request_id long, source long, target long")
    seen = []
    flood = routing.distances
    monkeypatch.setattr(routing, "distances", lambda *a: seen.append(flood(*a)) or seen[-1])
    for use, most in ((index, 100), (None, 145)):
        found = routing.routes(requests, nodes, frame(spark, edges), use).collect()
        assert {r["request_id"]: r["distance"] for r in found} == {i: dijkstra(edges, 0)[t] for i, t in enumerate(near)}
        state, _ = seen[-1]
        assert state.count() <= most
    assert state.count() == 144  # without the index all of it


def test_two_half_circles_are_less_than_one(spark):
    """A search from both ends follows fewer nodes than half of the flood, with landmarks fewer still."""
    edges = lattice(16, 16, random.Random(8))
    asked = spark.createDataFrame([(66, 74)], "source long, target long")
    sizes = {}
    keep = pairs._round
    for name, index in (("plain", None), ("landmarks", landmarks.table(frame(spark, edges), [0, 15, 240, 255]))):
        last = []
        with pytest.MonkeyPatch.context() as m:
            m.setattr(pairs, "_round", lambda *a, last=last: last.append(keep(*a)) or sizes.__setitem__(name, last[-1].count()) or last[-1])
            (row,) = pairs.meet(asked, frame(spark, edges), index).collect()
        assert row["distance"] == dijkstra(edges, 66)[74]
    assert sizes["landmarks"] < sizes["plain"] < 256


def test_ways_of_any_length(spark):
    state = spark.createDataFrame([(s, n, None if n == 0 else n - 1) for s in (1, 2) for n in range(37)], "source long, node long, prev long")
    ends = spark.createDataFrame([(s, n) for s in (1, 2) for n in (0, 1, 2, 7, 8, 31, 36)], "source long, node long")
    assert {(r["source"], r["node"]): r["node_ids"] for r in walk.paths(ends, state).collect()} == {(s, n): list(range(n + 1)) for s in (1, 2) for n in (0, 1, 2, 7, 8, 31, 36)}


def test_a_round_moves_only_its_frontier_and_offers(spark, monkeypatch):
    """The plan that finds the nearer offers has no exchange above what is known or above the edges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    nearer = routing.nearer

    def seen(offers, parts):
        found = nearer(offers, parts)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(routing, "nearer", seen)
    try:
        routing.distances(spark.createDataFrame([(0,)], "source long"), frame(spark, lattice(4, 4, random.Random(9))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 3
    for plan in plans:
        # the frontier to the edges and the offers to what is known; nothing else is moved, however many parts there are
        assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan


def test_scratch_tables_go(spark):
    before = {r[0] for r in spark.sql("SHOW DATABASES").collect()}
    pairs.meet(spark.createDataFrame([(1, 2)], "source long, target long"), frame(spark, [(1, 2, 1)]))
    routing.distances(spark.createDataFrame([(1,)], "source long"), frame(spark, [(1, 2, 1)]))
    assert {r[0] for r in spark.sql("SHOW DATABASES").collect()} == before


def test_overlay_of_cells(spark):
    """A long map in cells of at most eighteen nodes; one-way edges, an edge over several cells, a node without a place, an island; fewer rounds."""
    width, height, draw = 24, 3, random.Random(11)
    edges = lattice(width, height, draw) + [(0, 12, 9), (12, 900, 2), (900, 20, 2), (901, 902, 1)]
    edges = [e for k, e in enumerate(edges) if k % 11]
    nodes = spark.createDataFrame([(x * height + y, x / 100, y / 100) for x in range(width) for y in range(height)] + [(900, None, 1.0), (901, 0.23, 0.23), (902, 0.23, 0.23)], "id long, lat double, lng double")
    known = overlay.cells(nodes, 18)
    assert known.count() == width * height + 2 and known.where("node < 900").groupBy("cell").count().agg(F.max("count")).first()[0] <= 18
    whole = overlay.build(nodes, frame(spark, edges), 18)
    border = {r["node"] for r in whole.border.collect()}
    assert all(not border & set(r["inner"]) for r in whole.edges.collect()) and len(border) < 60
    asked = sorted({(draw.randrange(72), draw.randrange(72)) for _ in range(5)} | {(0, 71), (71, 0), (0, 1), (1, 0), (5, 5), (900, 3), (3, 900), (901, 902), (3, 901)})
    ends = spark.createDataFrame([(x,) for pair in asked for x in pair], "node long")
    short = overlay.with_ends(whole, ends)
    found = pairs.meet(spark.createDataFrame(asked, "source long, target long"), short).withColumn("request_id", F.monotonically_increasing_id())
    check(edges, contract.expand(found, short).collect(), asked)
    # rounds for cells crossed, not for nodes
    rounds = [routing.distances(spark.createDataFrame([(0,)], "source long"), g)[1] for g in (short, frame(spark, edges))]
    assert rounds[0] < 0.8 * rounds[1], rounds


@pytest.mark.parametrize("seed", range(2))
def test_nested_cells_have_the_graphs_distances(spark, seed):
    """Long strips: dozens of hops, several levels of cells; one-way streets, places that are shared or missing, weights of zero."""
    draw = random.Random(seed)
    edges = []
    for k in range(240):
        for n in ((k + 1) if k % 4 < 3 else k + 4, k + 4):
            if n < 240 and draw.random() < 0.95:
                w = draw.randrange(6)
                edges += [(k, n, w)] + ([(n, k, w + draw.randrange(2))] if draw.random() < 0.8 else [])
    edges += [(300, 301, 1), (7, 7, 2)]
    rows = [(k, None if k in (50, 51, 120) else float(k // 8), float(k % 4)) for k in range(240)]
    nodes = spark.createDataFrame(rows, "id long, lat double, lng double")
    sources = spark.createDataFrame([(1,), (130,), (999,)], "source long")
    found = nested.nested_distances(sources, nodes, frame(spark, edges), size=12).collect()
    ours = {(r["source"], r["node"]): r["dist"] for r in found}
    assert len(found) == len(ours)
    assert ours == {(s, n): d for s in (1, 130, 999) for n, d in dijkstra(edges, s).items()}


def test_nested_cells_take_no_round_for_each_hop(spark, monkeypatch):
    rounds = []

    def counted(*given):
        found = routing.distances(*given)
        rounds.append(found[1])
        return found

    monkeypatch.setattr(nested, "distances", counted)
    edges = [(k, k + 1, 1) for k in range(4000)]
    nodes = spark.range(4001).selectExpr("id", "id * 1.0d as lat", "0.0d as lng")
    found = nested.nested_distances(spark.createDataFrame([(0,)], "source long"), nodes, frame(spark, edges), size=64)
    assert {r["node"]: r["dist"] for r in found.collect()} == {k: float(k) for k in range(4001)}
    assert rounds[0] <= 64
