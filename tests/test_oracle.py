"""Every road query against its SQL on the smallest tables."""

import pytest

from roamgrid.plans.oracle import ORACLE
from roamgrid.plans.queries import QUERIES
from tests.conftest import same_rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir)


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["request_id", "status", "distance_meters", "estimated_time_secs", "n_points"]
    assert frame.count() > 0
