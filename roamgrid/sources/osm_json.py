"""OpenStreetMap documents in JSON: the query that asks for them, reading, writing, requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roamgrid.plans.lineage import written
from roamgrid.region import Region
from roamgrid.schemas import DOCUMENT, ELEMENT, REQUEST_BODY

# The road classes that are asked for
ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service")


def overpass_query(region: Region) -> Column:
    """The road query in Overpass QL, as a column: ways of the road classes in the box, then their nodes."""
    classes = "|".join(ROAD_CLASSES)
    return F.concat(F.lit(f'[out:json][timeout:90];way["highway"~"^({classes})$"]('), region.box_text(), F.lit(");out body;>;out skel qt;"))


def form_body(query: Column) -> Column:
    """The query as a form field, URL-encoded."""
    return F.concat(F.lit("data="), F.url_encode(query))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Elements of landed documents, one to a file, with their place: (file, pos, type, id, lat, lon, nodes, tags).

    One document is read by many tasks: a file is split like text, into records that end with a closing brace, wherever
    that stands. Whether a record begins within a string, and how deep, follows from the records before it; of these each
    split hands on its sums only. An element ends where a brace closes an object of the root's array; its records, from
    one split or two, are put together and decoded apart. (A compressed file is one split.)

    Unknown keys are ignored; absent id and coordinates are 0; documents without elements have no rows.
    """
    records = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    # a quote behind a backslash is no quote; what is left within quotes is no structure
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    records = records.withColumn("plain", plain).withColumn("quotes", (F.length("plain") - F.length(F.replace("plain", F.lit('"')))) % 2)
    bare = lambda text: F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")
    net = lambda text, opening, closing: (F.length(F.replace(text, F.lit(closing))) - F.length(F.replace(text, F.lit(opening)))).cast("long")
    deep = []
    for within in (0, 1):  # as if the record began outside of a string, and inside
        text = bare(F.concat(F.lit('"' * within), F.col("plain")))
        ends = (F.lit(within) + F.col("quotes")) % 2 == 0  # its brace is structure
        deep.append(F.struct((net(text, "{", "}") - F.when(ends, 1).otherwise(0)).alias("braces"), net(text, "[", "]").alias("brackets")))
    records = written(records.select("file", "start", "at", "value", "quotes", *(x.alias(f"deep{i}") for i, x in enumerate(deep))))
    order = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def upto(rows: DataFrame, **sums: str) -> DataFrame:
        """Running sums over a file: within the splits, and what the splits before have."""
        splits = rows.groupBy("file", "start").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
        before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        known = splits.select("file", "start", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before") for name in sums))
        own = rows.join(known, ["file", "start"])
        return own.withColumns({name: F.sum(c).over(order) + F.col(f"{name}_before") for name, c in sums.items()}).drop(*(f"{name}_before" for name in sums))

    placed = upto(records, quoted="quotes").withColumn("within", (F.col("quoted") - F.col("quotes")) % 2)
    placed = placed.withColumn("deep", F.when(F.col("within") == 0, F.col("deep0")).otherwise(F.col("deep1"))).select("file", "start", "at", "value", F.col("quoted") % 2 == 0, "deep.braces", "deep.brackets").toDF("file", "start", "at", "value", "closes", "braces", "brackets")
    placed = upto(placed, depth="braces", listed="brackets").withColumn("ends", (F.col("closes") & (F.col("depth") == 1) & (F.col("listed") == 1)).cast("long"))
    placed = upto(placed.select("file", "start", "at", "value", "depth", "ends"), ended="ends").withColumn("pos", F.col("ended") - F.col("ends"))
    # behind the last element come the root's end and nothing else
    parts = placed.groupBy("file", "pos").agg(F.max("ends").alias("whole"), F.sort_array(F.collect_list(F.struct("start", "at", "value"))).alias("parts")).where("whole = 1")
    text = F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"), F.lit("}"))
    head = F.regexp_replace(text, r'(?s)^.*?"elements"\s*:\s*\[', "")
    body = F.regexp_replace(F.when(F.col("pos") == 0, head).otherwise(text), r"(?s)^[^{]*", "")
    rows = parts.select("file", "pos", F.from_json(body, ELEMENT).alias("e"))
    return _decoded(rows, "file")


def decode_documents(documents: DataFrame, body: str = "body", *keys: str) -> DataFrame:
    """As ``read_documents`` for documents that are a text column."""
    return elements_of(documents.select(*keys, F.from_json(body, DOCUMENT)["elements"].alias("elements")), *keys)


def elements_of(documents: DataFrame, *keys: str) -> DataFrame:
    return _decoded(documents.select(*keys, F.posexplode("elements").alias("pos", "e")), *keys)


def _decoded(rows: DataFrame, *keys: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(*keys, "pos", "e.type", zero("e.id").alias("id"), zero("e.lat").alias("lat"), zero("e.lon").alias("lon"), "e.nodes", "e.tags")


def encode_documents(elements: DataFrame, *keys: str) -> DataFrame:
    """One JSON text for each key: (keys, body)."""
    element = F.struct("pos", F.struct("type", "id", "lat", "lon", "nodes", "tags").alias("e"))
    by_pos = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    gathered = elements.groupBy(*keys).agg(F.array_sort(F.collect_list(element), by_pos).alias("all"))
    return gathered.select(*keys, F.to_json(F.struct(F.transform("all", lambda x: x["e"]).alias("elements"))).alias("body"))


def decode_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(request_id, start_lat, start_lng, end_lat, end_lng) from JSON bodies."""
    points = bodies.select("request_id", F.from_json(body, REQUEST_BODY).alias("r"))
    return points.select("request_id", F.col("r.start.lat").alias("start_lat"), F.col("r.start.lng").alias("start_lng"), F.col("r.end.lat").alias("end_lat"), F.col("r.end.lng").alias("end_lng"))


def encode_responses(responses: DataFrame) -> DataFrame:
    """(request_id, status, body): the route or the error, as JSON."""
    route = F.to_json(F.struct(F.col("path"), F.col("distance_meters").alias("distanceMeters"), F.col("estimated_time_secs").alias("estimatedTimeSecs")))
    return responses.select("request_id", "status", F.when(F.col("status") == 200, route).otherwise(F.to_json(F.struct("error"))).alias("body"))
