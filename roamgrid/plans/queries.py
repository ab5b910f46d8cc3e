"""One query for each operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamgrid.functions import wkb
from roamgrid.functions.geo import haversine, kilometres, minutes, travel_seconds
from roamgrid.operators import contract, flood, graph, ingest, landmarks, nested, overlay, quality, response, routing, snap
from roamgrid.plans.lineage import cut, shared_folder, written
from roamgrid.region import REGION, Region, boxes
from roamgrid.sources import driver_tables as source
from roamgrid.sources import osm_json, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r3(c: Column | str) -> Column:
    return F.round(c, 3)


def _ways(spark: SparkSession, d: str) -> DataFrame:
    return ingest.way_elements(source.elements(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.node_elements(source.elements(spark, d), ["pos"])


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return ingest.graph_nodes(_nodes(spark, d), _ways(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    ways = cut(_ways(spark, d))
    return ingest.directed_edges(ingest.way_pairs(ways), ingest.graph_nodes(_nodes(spark, d), ways))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph with OSM ids as node ids, cut from its lineage: routing reads it every round."""
    elements = source.elements(spark, d)
    ways = cut(ingest.way_elements(elements))
    nodes = cut(ingest.graph_nodes(ingest.node_elements(elements, ["pos"]), ways))
    edges = ingest.directed_edges(ingest.way_pairs(ways), nodes)
    edges = edges.select(F.col("from_osm_id").alias("from_node_id"), F.col("to_osm_id").alias("to_node_id"), "weight", "osm_way_id")
    return nodes.select(F.col("osm_id").alias("id"), "osm_id", "lat", "lng"), cut(edges)


@query
def osm_element_counts(spark, d):
    return source.elements(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("nodes"), F.lit(0))).alias("n_refs"))


@query
def osm_json_roundtrip(spark, d):
    """Elements written as JSON documents of a thousand and read again."""
    documents = osm_json.encode_documents(source.elements(spark, d).withColumn("doc", F.expr("pos div 1000")), "doc")
    back = osm_json.decode_documents(documents, "body", "doc")
    return _summed(back)


def _summed(back: DataFrame) -> DataFrame:
    return back.groupBy("type").agg(F.count("*").alias("n"), F.sum("id").alias("sum_id"), F.sum(F.greatest(F.size(F.coalesce("nodes", F.array())), F.lit(0))).alias("n_refs"), _r3(F.sum(F.round("lat", 6))).alias("sum_lat"), F.count_if(F.try_element_at("tags", F.lit("oneway")).isNotNull()).alias("n_oneway"))


@query
def osm_json_files(spark, d):
    """The same through files, one a document, each read by as many tasks as it has splits."""
    documents = osm_json.encode_documents(source.elements(spark, d).withColumn("doc", F.expr("pos div 1000")), "doc")
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    documents.select("body").write.option("maxRecordsPerFile", 1).text(folder)  # no folder for each
    return _summed(osm_json.read_documents(spark, folder))


@query
def way_filter(spark, d):
    return _ways(spark, d).select("osm_way_id", F.size("nodes").cast("long").alias("n_refs"))


@query
def way_highway_filter(spark, d):
    return ingest.road_ways(_ways(spark, d)).select("osm_way_id", F.col("tags")["highway"].alias("highway"))


@query
def bbox_way_select(spark, d):
    """The box is the region's south-west quarter, so that ways fall outside."""
    box = Region("quarter", REGION.south, 16.985, REGION.west, 81.79)
    return ingest.way_ids_in_box(_ways(spark, d), _nodes(spark, d), box)


@query
def recurse_nodes(spark, d):
    ways = ingest.road_ways(_ways(spark, d))
    return ingest.graph_nodes(_nodes(spark, d), ways).select("osm_id")


@query
def node_dedupe_last_wins(spark, d):
    return _nodes(spark, d).select("osm_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query
def referenced_nodes(spark, d):
    return ingest.referenced(_ways(spark, d))


@query
def graph_nodes(spark, d):
    return _kept(spark, d).select("osm_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query
def way_pairs(spark, d):
    return ingest.way_pairs(_ways(spark, d)).select("osm_way_id", F.col("pos").cast("long").alias("pos"), "from_osm_id", "to_osm_id")


@query
def oneway_flag(spark, d):
    return _ways(spark, d).select("osm_way_id", ingest.is_oneway(F.col("tags")).alias("oneway"))


@query
def directed_edges(spark, d):
    return _edges(spark, d).groupBy("from_osm_id", "to_osm_id", "osm_way_id").agg(F.count("*").alias("n"))


@query
def edge_weights(spark, d):
    return _edges(spark, d).select("from_osm_id", "to_osm_id", "osm_way_id", _r3("weight").alias("weight"))


@query
def surrogate_keys(spark, d):
    return ingest.dense_ids(_kept(spark, d), "osm_id").select("id", "osm_id")


@query
def edge_fk_translate(spark, d):
    nodes, edges = ingest.build_graph(source.elements(spark, d), ["pos"])
    return edges.groupBy("from_node_id", "to_node_id").agg(F.count("*").alias("n"), F.min("osm_way_id").alias("first_way"), _r3(F.min("weight")).alias("weight"))


@query
def import_metrics(spark, d):
    """Counts that an import's own jobs took, read from the store's marker."""
    elements = source.elements(spark, d)
    ways, seen = ingest.observed(ingest.way_elements(elements), "n_ways")
    ways = cut(ways)
    nodes = ingest.dense_ids(ingest.graph_nodes(ingest.node_elements(elements, ["pos"]), ways), "osm_id")
    edges = ingest.directed_edges(ingest.way_pairs(ways), nodes).withColumn("id", F.monotonically_increasing_id())
    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    store.write_graph(nodes, edges, root, n_ways=seen)
    found = store.counts(spark, root)
    return spark.range(1).select(*(F.lit(found[name]).cast("long").alias(name) for name in ("n_ways", "n_nodes", "n_edges")))


@query
def dq_unique(spark, d):
    return quality.duplicate_keys(source.elements(spark, d).where("type = 'node'").withColumnRenamed("id", "osm_id"), "osm_id")


@query
def dq_not_null(spark, d):
    return quality.null_counts(source.elements(spark, d), "id", "lat", "lon", "nodes", "tags")


@query
def dq_fk_orphans(spark, d):
    """Pairs' ends that have no node: the references without coordinates."""
    pairs = ingest.way_pairs(_ways(spark, d)).select(F.col("osm_way_id").alias("id"), F.col("from_osm_id").alias("from_node_id"), F.col("to_osm_id").alias("to_node_id"))
    return quality.orphans(pairs, _kept(spark, d).select(F.col("osm_id").alias("id"))).groupBy("end").agg(F.count("*").alias("n"))


@query
def dq_edge_node_ratio(spark, d):
    return quality.graph_sanity(*_graph(spark, d))


@query
def adjacency_degree(spark, d):
    return graph.out_degrees(*_graph(spark, d)).select("node_id", "degree", F.round("total_weight", 2).alias("total_weight"))


@query
def adjacency_list(spark, d):
    item = lambda x: F.concat_ws(":", x["to_node_id"], F.round(x["weight"]).cast("long"))
    return graph.adjacency(*_graph(spark, d)).select("node_id", F.size("neighbors").cast("long").alias("degree"), F.array_join(F.transform("neighbors", item), ",").alias("neighbors"))


@query
def reduced_edges(spark, d):
    return graph.reduced(_graph(spark, d)[1]).select("from_node_id", "to_node_id", _r3("weight").alias("weight"))


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph written to a store in the shared folder and read again."""
    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    nodes, edges = _graph(spark, d)
    store.write_graph(nodes, edges.withColumn("id", F.monotonically_increasing_id()), root)
    return store.read_graph(spark, root)


@query
def node_by_osm_id(spark, d):
    return store.node_by_osm_id(_stored(spark, d)[0], 42).select("osm_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query
def edges_from_node(spark, d):
    return store.edges_from(_stored(spark, d)[1], 42).select(F.col("from_node_id").alias("from_osm_id"), F.col("to_node_id").alias("to_osm_id"), _r3("weight").alias("weight"), "osm_way_id")


@query
def stored_graph(spark, d):
    """Rows of both stored tables, and sums over their columns."""
    nodes, edges = _stored(spark, d)
    n = nodes.agg(F.count("*").alias("n"), F.sum("osm_id").alias("ids"), _r3(F.sum(F.round("lat", 6))).alias("total")).withColumn("name", F.lit("nodes"))
    e = edges.agg(F.count("*").alias("n"), F.sum(F.col("from_node_id") + F.col("to_node_id")).alias("ids"), F.round(F.sum(F.round("weight", 2)), 1).alias("total")).withColumn("name", F.lit("edges"))
    return n.unionByName(e)


@query
def node_pages(spark, d):
    """The third page of ten nodes."""
    return store.page(_stored(spark, d)[0], 2, 10).select("id", F.round("lat", 6).alias("lat"))


@query
def import_gate(spark, d):
    """An import into an empty store, into a full one, a forced one that replaces it, and one that fails: is it written, and how many nodes are there then."""
    root = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    nodes, edges = _graph(spark, d)
    edges = edges.withColumn("id", F.monotonically_increasing_id())
    less = store.without_node(nodes, edges, 1)

    def broken():
        raise OSError("no source")

    steps = []
    for number, (build, force) in enumerate([(lambda: (nodes, edges), False), (broken, False), (lambda: less, True), (broken, True)], 1):
        try:
            written = store.import_graph(spark, root, build, force)
        except OSError:
            written = False
        steps.append(store.read_graph(spark, root)[0].agg(F.lit(number).alias("step"), F.lit(written).alias("written"), F.count("*").alias("n_nodes"), F.count_if(F.col("id") == 1).alias("n_first")))
    return reduce(DataFrame.unionByName, steps)


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box around the islands of each region's nations."""
    nation = source.table(spark, d, "nation").join(source.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("long") + source.NATION
    return boxes(nation.select(F.col("r_name").alias("name"), source.latitude(k).alias("lat"), source.longitude(k).alias("lng")), "name")


@query
def form_body(spark, d):
    return _boxes(spark, d).select("name", osm_json.form_body(F.col("box")).alias("body"))


@query
def bbox_contains(spark, d):
    return source.requests(spark, d).select("request_id", REGION.contains(F.col("start_lat"), F.col("start_lng")).alias("start_in"), REGION.contains(F.col("end_lat"), F.col("end_lng")).alias("end_in"))


@query
def region_info(spark, d):
    return _boxes(spark, d).select("name", F.round("center.lat", 6).alias("center_lat"), F.round("center.lng", 6).alias("center_lng"), *(F.round(f"bbox.{x}", 6).alias(x) for x in ("south", "north", "west", "east")))


@query
def bbox_format(spark, d):
    return _boxes(spark, d).select("name", "box")


@query
def point_geometry(spark, d):
    """Every node's place as a binary point, read back."""
    rows = _kept(spark, d).select("osm_id", wkb.point(F.col("lat"), F.col("lng")).alias("p"))
    return rows.select("osm_id", F.octet_length("p").cast("long").alias("n_bytes"), F.round(wkb.latitude(F.col("p")), 6).alias("lat"), F.round(wkb.longitude(F.col("p")), 6).alias("lng"))


@query
def haversine_metres(spark, d):
    metres = haversine(F.col("start_lat"), F.col("start_lng"), F.col("end_lat"), F.col("end_lng"))
    return source.requests(spark, d).select("request_id", _r3(metres).alias("metres"))


@query
def eta(spark, d):
    """Of whole metres, so that no engine's last bit decides."""
    metres = F.round(haversine(F.col("start_lat"), F.col("start_lng"), F.col("end_lat"), F.col("end_lng")))
    return source.requests(spark, d).select("request_id", travel_seconds(metres).alias("secs"))


@query
def shown_values(spark, d):
    """Kilometres and minutes as shown, of whole hectometres and seconds."""
    metres = F.round(haversine(F.col("start_lat"), F.col("start_lng"), F.col("end_lat"), F.col("end_lng")) / 100) * 100
    return source.requests(spark, d).select("request_id", kilometres(metres).alias("km"), minutes(travel_seconds(metres)).alias("minutes"))


@query
def nearest_single(spark, d):
    nodes = _kept(spark, d).select(F.col("osm_id").alias("id"), "lat", "lng")
    return snap.nearest(nodes, 16.975, 81.778).select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query
def snap_batch(spark, d):
    """Every request's end, wherever it lies."""
    clicks = source.requests(spark, d).select(F.col("request_id").alias("click_id"), F.col("end_lat").alias("lat"), F.col("end_lng").alias("lng"))
    return snap.snap(clicks, cut(_kept(spark, d).withColumnRenamed("osm_id", "id"))).select("click_id", "node_id")


@query
def snap_region(spark, d):
    clicks = source.requests(spark, d).select(F.col("request_id").alias("click_id"), F.col("end_lat").alias("lat"), F.col("end_lng").alias("lng"))
    return snap.snap_in_region(clicks, cut(_kept(spark, d).withColumnRenamed("osm_id", "id")), REGION).select("click_id", "inside", F.coalesce("node_id", F.lit(-1)).alias("node_id"))


def _from_one(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return flood.flood([1], edges)


@query
def sssp_distances(spark, d):
    return _from_one(spark, _graph(spark, d)[1]).select("node", _r3("dist").alias("dist"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """The lattice's nodes, by row and column."""
    k = F.col("p_partkey")
    return source.table(spark, d, "part").select(k.alias("id"), F.floor(k / source.LATTICE).cast("double").alias("lat"), (k % source.LATTICE).cast("double").alias("lng"))


@query
def sssp_lattice(spark, d):
    """Over nested cells: the lattice has as many hops as rows."""
    start = spark.range(1, 2).withColumnRenamed("id", "source")
    return nested.nested_distances(start, _grid(spark, d), source.lattice(spark, d)).select("node", "dist")


def _routes(spark: SparkSession, d: str, requests: DataFrame) -> DataFrame:
    nodes, edges = _graph(spark, d)
    # a number of its own for each: two requests may have the same id (supplier 0 asks as 0 and as -0)
    asked = cut(requests.withColumn("number", F.monotonically_increasing_id()))
    found = routing.routes(asked.select(F.col("number").alias("request_id"), "source", "target"), nodes, edges).withColumnRenamed("request_id", "number")
    return asked.join(found, "number", "left").select("request_id", F.coalesce(F.array_join("node_ids", ">"), F.lit("")).alias("path"), _r3(F.coalesce("distance", F.lit(-1.0))).alias("distance"))


@query
def route_path(spark, d):
    """From node 1 to every part."""
    part = source.table(spark, d, "part")
    return _routes(spark, d, part.select(F.col("p_partkey").alias("request_id"), F.lit(1).cast("long").alias("source"), F.col("p_partkey").alias("target")))


@query
def route_same_node(spark, d):
    part = source.table(spark, d, "part")
    return _routes(spark, d, part.select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("source"), F.col("p_partkey").alias("target")))


@query
def route_unknown_node(spark, d):
    """To suppliers, which are no graph nodes, and to and from themselves."""
    s = source.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") + source.SUPPLIER).alias("n"))
    return _routes(spark, d, s.select(F.col("k").alias("request_id"), F.lit(1).cast("long").alias("source"), F.col("n").alias("target")).union(s.select(-F.col("k"), "n", "n")))


@query
def route_unreachable(spark, d):
    """To nations, which are islands of a region each."""
    n = source.table(spark, d, "nation").select((F.col("n_nationkey").cast("long") + source.NATION).alias("n"))
    return _routes(spark, d, n.select(F.col("n").alias("request_id"), F.lit(1).cast("long").alias("source"), F.col("n").alias("target")))


def _sized(asked: DataFrame, found: DataFrame) -> DataFrame:
    return asked.join(found, "request_id", "left").select("request_id", F.coalesce(F.size("node_ids"), F.lit(0)).cast("long").alias("n_points"), _r3(F.coalesce("distance", F.lit(-1.0))).alias("distance"))


@query
def route_many_sources(spark, d):
    """A request of every supplier, from a part of its own, to a part some way off: searched from both ends."""
    start = F.col("s_suppkey") * 20 - 19
    asked = source.table(spark, d, "supplier").select(start.alias("request_id"), start.alias("source"), (start + 7).alias("target"))
    return _sized(asked, routing.routes(asked, *_graph(spark, d)))


@query
def landmark_table(spark, d):
    """Distances of every node to and from parts 1, 2 and 3."""
    places = [F.get(name, i).alias(f"{name}_{i + 1}") for name in ("out", "into") for i in range(3)]
    rows = landmarks.table(_graph(spark, d)[1], [1, 2, 3]).select("node", *places)
    return rows.select("node", *(_r3(F.coalesce(c, F.lit(-1.0))).alias(c) for c in rows.columns[1:]))


@query
def route_by_landmarks(spark, d):
    """From every nation's island to its part and back (no route), and from that part to another: bounded by landmarks."""
    n = F.col("n_nationkey").cast("long")
    way = lambda k, a, b: F.struct((n * 3 + k).alias("request_id"), a.alias("source"), b.alias("target"))
    island, own = n + source.NATION, n * 7 + 1
    asked = source.table(spark, d, "nation").select(F.explode(F.array(way(0, island, own), way(1, own, island), way(2, own, own + 3))).alias("x")).select("x.*")
    nodes, edges = _graph(spark, d)
    index = landmarks.table(edges, landmarks.choose(nodes, edges))
    return _sized(asked, routing.routes(asked, nodes, edges, index))


@query
def collapsed_chains(spark, d):
    """What is left of the map of bends when its chains are collapsed: nodes and edges before, chains, nodes in them, nodes that stay."""
    edges = written(source.streets(spark, d))
    shape = contract.contract(edges)
    ends = F.explode(F.array("from_node_id", "to_node_id")).alias("node")
    before = edges.agg(F.count("*").alias("n_edges")).join(edges.select(ends).distinct().agg(F.count("*").alias("n_nodes")))
    chains = shape.chains.agg(F.count("*").alias("n_chains"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("n_inner"))
    return before.join(chains).withColumn("n_stay", F.col("n_nodes") - F.col("n_inner"))


def _collapsed(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    """Routes over the collapsed map of bends, with the bends put back."""
    shape = contract.contract(source.streets(spark, d))
    edges = written(contract.split_at(shape, asked.select(F.explode(F.array("source", "target")).alias("node"))).edges())
    nodes = edges.select(F.col("to_node_id").alias("id")).distinct()
    return contract.expand(routing.routes(asked, nodes, edges), edges)


def _lengths(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """(request_id, length): what the ways' steps weigh on the map that is not collapsed."""
    steps = F.transform(F.slice("node_ids", F.lit(1), F.size("node_ids") - 1), lambda x, i: F.struct(x.alias("from_node_id"), F.get("node_ids", i + 1).alias("to_node_id")))
    each = found.select("request_id", F.explode_outer(steps).alias("s")).select("request_id", "s.*")
    return each.join(graph.reduced(source.streets(spark, d)), ["from_node_id", "to_node_id"], "left").groupBy("request_id").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("length"))


@query
def collapsed_distances(spark, d):
    """From customer 1 over the collapsed map to every customer, and into the chains: to the first bend of the order with each
    nation's number. The distance as found, and as the way's steps add up on the map that is not collapsed."""
    customer = source.table(spark, d, "customer").select(F.col("c_custkey").alias("target"))
    bends = source.table(spark, d, "nation").select((F.lit(source.BEND) + (F.col("n_nationkey") + 1) * 8 + 1).cast("long").alias("target"))
    asked = cut(customer.union(bends).select(F.col("target").alias("request_id"), F.lit(1).cast("long").alias("source"), "target"))
    found = written(_collapsed(spark, d, asked))
    whole = found.join(_lengths(spark, d, found), "request_id")
    return asked.select("request_id").join(whole, "request_id", "left").select("request_id", F.coalesce("distance", F.lit(-1.0)).alias("distance"), F.coalesce("length", F.lit(-1.0)).alias("length"))


@query
def route_overlay(spark, d):
    """Of every nation, a route over the lattice of parts from cell border to cell border."""
    nodes = _grid(spark, d)
    n = F.col("n_nationkey").cast("long")
    asked = cut(source.table(spark, d, "nation").select(n.alias("request_id"), (n * 7 + 1).alias("source"), (200 - n * 3).alias("target")))
    whole = overlay.build(nodes, source.lattice(spark, d), 16)
    edges = overlay.with_ends(whole, asked.select(F.explode(F.array("source", "target")).alias("node")))
    found = contract.expand(routing.routes(asked, nodes, edges), edges)
    return asked.select("request_id").join(found, "request_id", "left").select("request_id", F.coalesce("distance", F.lit(-1.0)).alias("distance"))


def _own_place(key: Column) -> list[Column]:
    """lat and lng in the region that no other key below 2^43 has (``latitude`` and ``longitude`` come again after 1009 * 1013 keys)."""
    row, column = (key * 2531) % 4096, (F.shiftright(key, 12) * 1103515245) % (1 << 31)
    return [(F.lit(REGION.south) + row * F.lit(0.05) / F.lit(4096.0)).alias("lat"), (F.lit(REGION.west) + column * F.lit(0.06) / F.lit(2.0**31)).alias("lng")]


def _chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests over chains of ten parts whose sixth is no node: to the fifth, over the hole to the ninth, without an end, and to outside."""
    part = source.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("osm_id"), *_own_place(F.col("p_partkey")))
    edges = part.where("id % 10 != 9").select(F.col("id").alias("from_node_id"), (F.col("id") + 1).alias("to_node_id"), F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("osm_way_id"))
    start = F.col("id") - F.col("id") % 10
    start_lat, start_lng = _own_place(start)
    r = part.where("id > 9 and id % 10 in (2, 3, 4, 8)").select(F.col("id").alias("request_id"), start_lat.alias("start_lat"), start_lng.alias("start_lng"), F.when(F.col("id") % 10 != 2, F.col("lat") + F.when(F.col("id") % 10 == 3, 1).otherwise(0)).alias("end_lat"), F.col("lng").alias("end_lng"))
    return r, part.where("id % 10 != 5"), edges


def _statuses(answers: DataFrame) -> DataFrame:
    return answers.select("request_id", "status", F.coalesce("distance_meters", F.lit(-1.0)).alias("distance"), F.size(F.coalesce("path", F.array())).cast("long").alias("n_points"))


@query
def respond_broken_graph(spark, d):
    return _statuses(response.respond(*_chain(spark, d)))


@query
def respond_nothing_near(spark, d):
    """Nodes without places."""
    requests, nodes, edges = _chain(spark, d)
    none = F.lit(None).cast("double")
    return _statuses(response.respond(requests, nodes.withColumns({"lat": none, "lng": none}), edges))


@query
def respond_empty_graph(spark, d):
    requests, nodes, edges = _chain(spark, d)
    return _statuses(response.respond(requests, nodes.limit(0), edges.limit(0)))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return response.respond(source.requests(spark, d), *_graph(spark, d))


@query
def route_batch(spark, d):
    """Every request's response."""
    none = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    return _responses(spark, d).select("request_id", "status", _r3(F.coalesce("distance_meters", F.lit(-1.0))).alias("distance_meters"), none(F.col("estimated_time_secs")).alias("estimated_time_secs"), none(F.when(F.col("path").isNotNull(), F.size("path"))).alias("n_points"))


@query
def polyline(spark, d):
    point = lambda x: F.concat_ws(" ", F.format_string("%.5f", x["lat"]), F.format_string("%.5f", x["lng"]))
    return _responses(spark, d).where("status = 200").select("request_id", F.array_join(F.transform("path", point), ",").alias("line"))


@query
def route_errors(spark, d):
    return _responses(spark, d).where("status <> 200").select("request_id", "status", "error")


@query
def route_response_json(spark, d):
    """Requests as JSON bodies, responses as JSON bodies; read back."""
    r = source.requests(spark, d)
    point = lambda end: F.struct(F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lng").alias("lng")).alias(end)
    bodies = r.select("request_id", F.to_json(F.struct(point("start"), point("end"))).alias("body"))
    replies = osm_json.encode_responses(response.respond(osm_json.decode_requests(bodies), *_graph(spark, d)))
    return replies.select("request_id", "status", F.coalesce(F.get_json_object("body", "$.estimatedTimeSecs").cast("long"), F.lit(-1)).alias("secs"), F.coalesce(F.get_json_object("body", "$.error"), F.lit("")).alias("error"))
