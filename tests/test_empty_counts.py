"""Counts of tables that no task has written."""

from pyspark.sql import functions as F

from roamgrid.operators import walk
from roamgrid.operators.overlay import build, with_ends
from roamgrid.plans.lineage import scratch
from tests.test_search import frame


def nothing(spark, schema):
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)


def test_rows_without_a_task_are_counted(spark):
    with scratch(spark) as tables:
        _, counts = tables.keep_counted(nothing(spark, "node long"), "node", some=F.col("node") > 1)
    assert counts == {"rows": 0, "some": 0}


def test_no_tree_has_no_ways(spark):
    assert walk.paths(nothing(spark, "source long, node long"), nothing(spark, "source long, node long, prev long")).isEmpty()


def test_ends_that_are_all_on_borders_add_no_ways(spark):
    """Every node is on a border: there is nothing to search for inside the cells."""
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "id long, lat double, lng double")
    edges = frame(spark, [(a, b, 1) for a in range(4) for b in range(4) if a != b])
    whole = build(nodes, edges, 2)
    ends = spark.createDataFrame([(0,), (3,)], "node long")
    assert with_ends(whole, ends).count() == whole.edges.count()
