"""The graph's tables in a relational database, by versions as in the Parquet store, read in parallel by ranges of the id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamgrid.schemas import EDGES, NODES


def read_table(spark: SparkSession, url: str, name: str, partitions: int = 8, **options: str) -> DataFrame:
    """A table with an ``id``, in ranges of it between its least and greatest; filters and columns are pushed down."""
    source = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    ends = source.load().agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        return source.load()
    return source.options(partitionColumn="id", lowerBound=ends["low"], upperBound=ends["high"] + 1, numPartitions=partitions).load()


def current_version(spark: SparkSession, url: str, versions: str = "graph_versions", **options: str) -> str | None:
    """The newest complete version, or None; a database without the table of versions has none."""
    try:
        row = spark.read.format("jdbc").options(url=url, dbtable=versions, **options).load().orderBy(F.desc("written"), F.desc("version")).first()
    except Exception as error:  # the drivers have errors of their own for a missing table
        if "does not exist" in str(error) or "TABLE_OR_VIEW_NOT_FOUND" in str(error) or "doesn't exist" in str(error) or "no such table" in str(error):
            return None
        raise
    return row[0] if row else None


def read_graph(spark: SparkSession, url: str, nodes: str = "nodes", edges: str = "edges", partitions: int = 8, **options: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the valid version, empty if there is none."""
    version = current_version(spark, url, **options)
    if version is None:
        return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    pick = lambda name, schema: read_table(spark, url, f"{name}_{version}", partitions, **options).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    return pick(nodes, NODES), pick(edges, EDGES)


def write_graph(nodes: DataFrame, edges: DataFrame, url: str, batch: int = 5000, **options: str) -> str:
    """A new version in tables of its own, then the row that makes it valid: readers never see half of one, and a failed write leaves the version before."""
    spark, version = nodes.sparkSession, f"v{uuid.uuid4().hex[:16]}"
    write = lambda rows, name, mode: rows.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode(mode).save()
    write(nodes.select(NODES.names), f"nodes_{version}", "errorifexists")
    write(edges.select(EDGES.names), f"edges_{version}", "errorifexists")
    write(spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written")), "graph_versions", "append")
    return version
