"""The driver's star schema read as a road network, by integer arithmetic that any SQL dialect repeats.

Parts are junctions (those whose key is a multiple of 97 have no coordinates), suppliers are nodes that no way refers to,
nations are islands; an order's lines, in order, are a way, and so are a region's nations. Part nodes whose key is a
multiple of 10 occur twice, first with other coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER, NATION, REGION_WAY, LATER = 1_000_000, 2_000_000, 5_000_000_000, 10_000_000
BEND = 20_000_000
DEPOTS = 8
LATTICE = 45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latitude(key: Column) -> Column:
    return F.lit(16.96) + ((key * 7919) % 1009) * F.lit(0.05) / F.lit(1009.0)


def longitude(key: Column) -> Column:
    return F.lit(81.76) + ((key * 104729) % 1013) * F.lit(0.06) / F.lit(1013.0)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, type, id, lat, lon, nodes, tags) of all elements."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER).alias("k"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + NATION).alias("k"), F.col("n_regionkey").alias("r"))
    refs, tags = F.lit(None).cast("array<bigint>"), F.lit(None).cast("map<string,string>")
    node = lambda df, pos, at: df.select(pos.alias("pos"), F.lit("node").alias("type"), F.col("k").alias("id"), latitude(at).alias("lat"), longitude(at).alias("lon"), refs.alias("nodes"), tags.alias("tags"))
    k = F.col("k")
    known = part.where("k % 97 != 0").unionByName(supplier).unionByName(nation.select("k"))
    nodes = node(known, k + LATER, k).unionByName(node(known.where("k % 10 = 0 and k < 1000000"), k, k + 1))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_partkey"]).alias("nodes"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status, level = F.col("o_orderstatus"), F.col("o_orderpriority")
    oneway = F.when(status == "F", "yes").when(status == "O", "-1")
    highway = F.when(level == "1-URGENT", "motorway").when(level == "2-HIGH", "primary").when(level == "3-MEDIUM", "residential").when(level == "4-NOT SPECIFIED", "footway").when(level == "5-LOW", "service")
    pairs = F.filter(F.array(F.struct(F.lit("oneway").alias("k"), oneway.alias("v")), F.struct(F.lit("highway").alias("k"), highway.alias("v"))), lambda x: x["v"].isNotNull())
    none = F.lit(None).cast("double")
    ways = orders.select((F.col("o_orderkey") + 2 * LATER).alias("pos"), F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), none.alias("lat"), none.alias("lon"), "nodes", F.map_from_entries(pairs).alias("tags"))
    rings = nation.groupBy("r").agg(F.array_sort(F.collect_list("k")).alias("nodes"))
    islands = rings.select((F.col("r") + REGION_WAY).alias("pos"), F.lit("way").alias("type"), (F.col("r") + REGION_WAY).alias("id"), none.alias("lat"), none.alias("lon"), "nodes", tags.alias("tags"))
    return nodes.unionByName(ways).unionByName(islands)


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (from_node_id, to_node_id, weight) both ways between neighbours of a grid of parts, ``LATTICE`` wide; weights are whole numbers."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    right = k.where(f"k % {LATTICE} != 0").select("k", (F.col("k") + 1).alias("n"))
    pairs = right.union(k.select("k", (F.col("k") + LATTICE).alias("n"))).join(k.withColumnRenamed("k", "n"), "n", "left_semi")
    weight = (1 + (F.col("k") * 31 + F.col("n") * 17) % 7).cast("double")
    pairs = pairs.select(F.col("k").alias("a"), F.col("n").alias("b"), weight.alias("weight"))
    return pairs.select(F.col("a").alias("from_node_id"), F.col("b").alias("to_node_id"), "weight").union(pairs.select("b", "a", "weight"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a map of bends: an order is a street from its customer over its lines, in order, to the least of their
    suppliers; status F makes it one-way. Bends are ``BEND`` + 8 * order + line; weights are whole numbers."""
    line = F.struct((F.lit(BEND) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node"), (1 + (F.col("l_partkey") * 31 + F.col("l_linenumber") * 17) % 7).alias("step"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("bends"), (F.min("l_suppkey") + SUPPLIER).alias("shop"))
    street = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    end = F.struct(F.col("shop").alias("node"), (1 + F.col("o_orderkey") % 7).alias("step"))
    way = F.concat(F.array(F.struct(F.col("o_custkey").alias("node"), F.lit(0).cast("long").alias("step"))), "bends", F.array(end))
    steps = F.transform(F.slice("way", F.lit(2), F.size("way") - 1), lambda x, i: F.struct(F.get("way", i)["node"].alias("a"), x["node"].alias("b"), x["step"].cast("double").alias("weight")))
    pairs = street.select("o_orderstatus", way.alias("way")).select("o_orderstatus", F.explode(steps).alias("s")).select("o_orderstatus", "s.*")
    forward = pairs.select(F.col("a").alias("from_node_id"), F.col("b").alias("to_node_id"), "weight")
    return forward.unionByName(pairs.where("o_orderstatus <> 'F'").select(F.col("b").alias("from_node_id"), F.col("a").alias("to_node_id"), "weight"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each event: from one of eight depots to a place of its own, in a box slightly larger than the region."""
    e, d = F.col("event_id"), F.col("event_id") % DEPOTS
    box = lambda x, m, n, low, size: F.lit(low) + ((x * m) % n) * F.lit(size) / F.lit(float(n))
    start_lat, start_lng = box(d * 211 + 57, 7919, 1009, 16.955, 0.06), box(d * 173 + 31, 104729, 1013, 81.755, 0.07)
    end_lat, end_lng = box(e, 6007, 1009, 16.955, 0.06), box(e, 7001, 1013, 81.755, 0.07)
    return table(spark, sf_dir, "events").select(e.alias("request_id"), start_lat.alias("start_lat"), start_lng.alias("start_lng"), end_lat.alias("end_lat"), end_lng.alias("end_lng"))
