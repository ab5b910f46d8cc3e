"""Views of a graph: neighbour lists, degrees, and the reduced edges that routing reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, neighbors): sorted array<struct<to_node_id, weight>>, empty for sinks.

    Keys are all nodes and every edge's start. A node's list is as long as its out-degree; routing doesn't use it.
    """
    lists = edges.groupBy(F.col("from_node_id").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("to_node_id", "weight"))).alias("neighbors"))
    return nodes.select(F.col("id").alias("node_id")).distinct().join(lists, "node_id", "full").withColumn("neighbors", F.coalesce("neighbors", F.expr("cast(array() as array<struct<to_node_id: bigint, weight: double>>)")))


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree, total_weight) for the same keys, without lists."""
    sums = edges.groupBy(F.col("from_node_id").alias("node_id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("total_weight"))
    return nodes.select(F.col("id").alias("node_id")).distinct().join(sums, "node_id", "full").fillna(0, ["degree", "total_weight"])


def keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): where a route may begin or end."""
    return nodes.select(F.col("id").alias("node")).union(edges.select("from_node_id")).distinct()


def reduced(edges: DataFrame) -> DataFrame:
    """(from_node_id, to_node_id, weight): the least of parallel edges, which alone can be on a shortest path."""
    sound = edges.where(F.col("weight") < 1.7976931348623157e308)  # NaN and infinity never shorten a path
    return sound.groupBy("from_node_id", "to_node_id").agg(F.min("weight").alias("weight"))
