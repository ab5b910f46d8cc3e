"""Schemas of documents, tables, requests and responses."""

from __future__ import annotations

from pyspark.sql import types as T

ELEMENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("nodes", T.ArrayType(T.LongType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
DOCUMENT = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT))])
NODES = T.StructType([T.StructField("id", T.LongType()), T.StructField("osm_id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
EDGES = T.StructType([T.StructField("id", T.LongType()), T.StructField("from_node_id", T.LongType()), T.StructField("to_node_id", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("osm_way_id", T.LongType())])
POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
REQUEST_BODY = T.StructType([T.StructField("start", POINT), T.StructField("end", POINT)])
