"""Route responses: polyline, distance, travel time, and a status for each request in place of an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.functions.geo import no_route_text, outside_text, travel_seconds
from roamgrid.operators.routing import routes
from roamgrid.operators.snap import snap
from roamgrid.plans.lineage import cut
from roamgrid.region import REGION, Region


def polylines(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, path, distance, whole): node ids become an ordered array<struct<lat, lng>>, from snapped node to snapped node.

    ``whole`` is false where a node of the route is no node of the graph (an edge leads there): such a path has a hole.
    """
    steps = found.select("request_id", F.posexplode("node_ids").alias("pos", "id")).join(nodes.select("id", "lat", "lng"), "id")
    path = F.transform(F.sort_array(F.collect_list(F.struct("pos", "lat", "lng"))), lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng")))
    lines = steps.groupBy("request_id").agg(path.alias("path"))
    whole = F.coalesce(F.size("path") == F.size("node_ids"), F.lit(False))
    return found.join(lines, "request_id", "left").select("request_id", "path", "distance", whole.alias("whole"))


def respond(requests: DataFrame, nodes: DataFrame, edges: DataFrame, region: Region = REGION) -> DataFrame:
    """(request_id, status, error, path, distance_meters, estimated_time_secs) for every request.

    In this order: 503 for an empty graph, 500 for a missing coordinate, 400 for a start and then an end outside the
    region, 503 where nothing is near, 404 without a route, 500 for a route over an edge's end that is no node, 200.
    """
    empty = F.lit(bool(nodes.isEmpty()))
    inside = lambda end: F.coalesce(region.contains(F.col(f"{end}_lat"), F.col(f"{end}_lng")), F.lit(False))
    missing = F.greatest(*(F.col(c).isNull() for c in ("start_lat", "start_lng", "end_lat", "end_lng")))
    status = F.when(empty, 503).when(missing, 500).when(~inside("start") | ~inside("end"), 400)
    error = F.when(empty, "The graph is empty").when(missing, "A coordinate is missing").when(~inside("start"), outside_text(region, F.col("start_lat"), F.col("start_lng"))).when(~inside("end"), outside_text(region, F.col("end_lat"), F.col("end_lng")))
    marked = cut(requests.withColumns({"status": status, "error": error}))
    good = marked.where("status is null")
    click = lambda end: good.select(F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lng").alias("lng"))
    # equal points are snapped once
    points = click("start").union(click("end")).distinct().withColumn("click_id", F.struct("lat", "lng"))
    hits = cut(snap(points, nodes)).select("click_id.lat", "click_id.lng", "node_id")
    at = lambda end, name: hits.select(F.col("lat").alias(f"{end}_lat"), F.col("lng").alias(f"{end}_lng"), F.col("node_id").alias(name))
    ends = good.select("request_id", "start_lat", "start_lng", "end_lat", "end_lng").join(at("start", "source"), ["start_lat", "start_lng"]).join(at("end", "target"), ["end_lat", "end_lng"]).select("request_id", "source", "target")
    ends = cut(ends)
    found = cut(routes(ends, nodes, edges))
    lines = polylines(found, nodes)
    done = marked.select("request_id", F.col("status").alias("early"), F.col("error").alias("early_error")).join(ends, "request_id", "left").join(lines, "request_id", "left")
    broken = F.col("distance").isNotNull() & ~F.col("whole")
    status = F.coalesce("early", F.when(F.col("source").isNull(), 503).when(F.col("distance").isNull(), 404).when(broken, 500).otherwise(200))
    error = F.coalesce("early_error", F.when(F.col("source").isNull(), F.lit("Nothing is near")).when(F.col("distance").isNull(), no_route_text(F.col("source"), F.col("target"))).when(broken, F.lit("The route leads over a node without a place")))
    path, distance = F.when(~broken, F.col("path")), F.when(~broken, F.col("distance"))
    return done.select("request_id", status.alias("status"), error.alias("error"), path.alias("path"), distance.alias("distance_meters"), travel_seconds(distance).alias("estimated_time_secs"))
