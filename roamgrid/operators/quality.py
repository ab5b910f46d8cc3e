"""Checks that a database's constraints would make: each returns the offending rows or one row of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that are not unique."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def null_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of nulls of each column."""
    return rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, each such end once: (id, end)."""
    keys = nodes.select(F.col("id").alias("end"))
    end = lambda c: edges.select("id", F.col(c).alias("end"))
    return end("from_node_id").union(end("to_node_id")).join(keys, "end", "left_anti").select("id", "end")


def graph_sanity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_negative weights, and ok (edges at least as many as nodes, no negative weight)."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("weight") < 0).alias("n_negative"))
    return n.join(e).withColumn("ok", (F.col("n_edges") >= F.col("n_nodes")) & (F.col("n_negative") == 0))
