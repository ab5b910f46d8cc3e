import math
import random
import struct

from pyspark.sql import functions as F

from roamgrid.functions import wkb
from roamgrid.region import boxes


def test_points_as_binary(spark):
    draw = random.Random(1)
    places = [(16.98, 81.78), (0.0, -0.0), (-90.0, 180.0), (90.0, -180.0), (1.0, 2.0), (0.5, -0.25), (math.nextafter(2, 0), math.nextafter(2, 3)), (math.nextafter(64, 0), 1e-9), (1e-300, -1e-5)]
    places += [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(300)] + [(2.0**k, -(2.0 ** -k)) for k in range(0, 60)]
    rows = spark.createDataFrame(places, "lat double, lng double").withColumn("p", wkb.point(F.col("lat"), F.col("lng")))
    for r in rows.select("lat", "lng", "p", wkb.latitude(F.col("p")).alias("y"), wkb.longitude(F.col("p")).alias("x")).collect():
        assert bytes(r["p"]) == struct.pack("<BIIdd", 1, 0x20000001, 4326, r["lng"], r["lat"])
        assert (r["y"], r["x"]) == (r["lat"], r["lng"])
    none = spark.createDataFrame([(None, 1.0), (1.0, None), (math.nan, 1.0), (math.inf, 1.0)], "lat double, lng double")
    assert [r[0] for r in none.select(wkb.point(F.col("lat"), F.col("lng"))).collect()] == [None] * 4
    assert spark.range(1).select(wkb.latitude(F.unhex(F.lit("0101")))).first()[0] is None


def test_boxes_of_places(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, -2.0), ("b", None, 1.0), ("b", 5.0, 6.0), ("c", None, None)], "name string, lat double, lng double")
    found = {r["name"]: r for r in boxes(rows, "name").collect()}
    assert set(found) == {"a", "b"}
    assert tuple(found["a"]["bbox"]) == (1.0, 3.0, -2.0, 2.0) and tuple(found["a"]["center"]) == (2.0, 0.0) and found["a"]["box"] == "1.000000,-2.000000,3.000000,2.000000"
    assert tuple(found["b"]["bbox"]) == (5.0, 5.0, 6.0, 6.0)
