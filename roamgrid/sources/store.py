"""The graph's tables in Parquet: versions, a marker that names the valid one, the import gate, lookups.

A version is written whole before the marker is: readers never see nodes without edges, and a failed import leaves the
version before it in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from roamgrid.plans.lineage import remove
from roamgrid.schemas import EDGES, NODES


_MARK = "version string, written timestamp, counts map<string,long>"


def _marks(spark: SparkSession, root: str) -> list[Row]:
    """The rows of complete versions, newest first; a row each import, so they are few. Any file system that Spark reads."""
    try:
        return spark.read.schema(_MARK).parquet(f"{root}/_versions").orderBy(F.desc("written"), F.desc("version")).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def current_version(spark: SparkSession, root: str) -> str | None:
    """The newest complete version, or None."""
    return next((r["version"] for r in _marks(spark, root)), None)


def counts(spark: SparkSession, root: str) -> dict[str, int]:
    """What the import of the valid version counted while it wrote: n_nodes, n_edges, and what was given to it."""
    return next((dict(r["counts"]) for r in _marks(spark, root)), {})


def write_graph(nodes: DataFrame, edges: DataFrame, root: str, **seen: Observation) -> str:
    """Nodes range-partitioned and sorted by osm_id, edges hash-partitioned and sorted by their start, then the marker.

    So a lookup reads the few row groups whose statistics hold its key. Rows are counted by the jobs that write them, and
    the counts go into the marker, with those of other observations that these jobs complete.
    """
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    own = {"n_nodes": Observation(), "n_edges": Observation()}
    number = F.count(F.lit(1))
    nodes.select(NODES.names).repartitionByRange("osm_id").sortWithinPartitions("osm_id").observe(own["n_nodes"], number.alias("n_nodes")).write.parquet(f"{root}/{version}/nodes")
    edges.select(EDGES.names).repartition("from_node_id").sortWithinPartitions("from_node_id").observe(own["n_edges"], number.alias("n_edges")).write.parquet(f"{root}/{version}/edges")
    found = {name: value for x in (own | seen).values() for name, value in x.get.items()}
    every = F.create_map(*(F.lit(x) for pair in found.items() for x in pair)).cast("map<string,long>")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"), every.alias("counts")).write.mode("append").parquet(f"{root}/_versions")
    return version


def remove_old(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all versions but the newest ``keep``; how many went. Their markers stay, as a log of imports: no reader asks for an old one."""
    return sum(remove(spark, f"{root}/{r['version']}") for r in _marks(spark, root)[max(1, keep) :])


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the valid version, empty if there is none."""
    version = current_version(spark, root)
    if version is None:
        return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    return spark.read.schema(NODES).parquet(f"{root}/{version}/nodes"), spark.read.schema(EDGES).parquet(f"{root}/{version}/edges")


def import_graph(spark: SparkSession, root: str, build: Callable[[], tuple[DataFrame, DataFrame]], force: bool = False) -> bool:
    """Build and write unless a graph with nodes is there already; True if it was written."""
    if not force and not read_graph(spark, root)[0].isEmpty():
        return False
    write_graph(*build(), root)
    return True


def node_by_osm_id(nodes: DataFrame, osm_id: int) -> DataFrame:
    return nodes.where(F.col("osm_id") == osm_id)


def edges_from(edges: DataFrame, node_id: int) -> DataFrame:
    return edges.where(F.col("from_node_id") == node_id)


def node_exists(nodes: DataFrame, node_id: int) -> bool:
    return not nodes.where(F.col("id") == node_id).isEmpty()


def page(rows: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """A page of rows in the given order (by id without one), the first being 0."""
    return rows.orderBy(*(order or ("id",))).offset(number * size).limit(size)


def without_node(nodes: DataFrame, edges: DataFrame, node_id: int) -> tuple[DataFrame, DataFrame]:
    """The graph without a node and the edges that begin or end there, to be written as a new version."""
    return nodes.where(F.col("id") != node_id), edges.where((F.col("from_node_id") != node_id) & (F.col("to_node_id") != node_id))
