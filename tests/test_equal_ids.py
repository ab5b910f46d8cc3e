"""Requests that share an id."""

import os

from roamgrid.plans.oracle import ORACLE
from roamgrid.plans.queries import QUERIES
from tests.conftest import same_rows


def test_requests_with_the_same_id_have_a_row_each(spark, tmp_path, sf_dir):
    """Part 1,000,000 is a junction with the number of supplier 0, whose two requests both have the id 0."""
    rows = {
        "part": spark.createDataFrame([(1,), (2,), (1_000_000,)], "p_partkey long"),
        "supplier": spark.createDataFrame([(0,), (1,)], "s_suppkey long"),
        "orders": spark.createDataFrame([(1, "P", "3-MEDIUM")], "o_orderkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 2), (1, 1_000_000, 0, 3)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "nation": spark.read.parquet(f"{sf_dir}/nation.parquet"),
    }
    for name, frame in rows.items():
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        os.rename(next((tmp_path / f"{name}.parquet").glob("part-*.parquet")), tmp_path / f"{name}-file")
    folder = tmp_path / "in"
    folder.mkdir()
    for name in rows:
        os.rename(tmp_path / f"{name}-file", folder / f"{name}.parquet")
    found = QUERIES["route_unknown_node"](spark, str(folder))
    assert found.count() == 4
    same_rows(found, ORACLE["route_unknown_node"], str(folder))
