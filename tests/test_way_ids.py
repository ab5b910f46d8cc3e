"""Ways of a box, by their ids alone."""

from roamgrid.plans.queries import QUERIES


def test_ways_are_put_together_once(spark, sf_dir):
    """What finds the ways is what is asked for: lines are read, gathered and joined to their orders once."""
    found = QUERIES["bbox_way_select"](spark, sf_dir)
    assert found._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
    assert found.count() == found.distinct().count() > 0
