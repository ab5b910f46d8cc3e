from pyspark.sql import functions as F

from roamgrid.operators import snap
from roamgrid.plans.lineage import scratch


def test_a_click_looks_into_few_leaves(spark):
    """The nearest place of one leaf bounds the way down: clicks among the places look into two leaves or so, not into all around."""
    place = lambda c, n: (F.col("id") * c % n / n).alias("lat" if n == 1009 else "lng")
    index = snap.build(spark.range(3000).select("id", place(7919, 1009), place(104729, 1013)))
    clicks = spark.range(400).select(F.col("id").alias("key"), place(6007, 1009), place(7001, 1013))
    with scratch(spark) as tables:
        assert snap._descend(tables, clicks, index).count() < 3 * 400
