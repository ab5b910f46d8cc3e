"""Nearest nodes in the degree metric, ties to the smaller id.

An index is a quadtree over the nodes' places, made once for any number of batches: places that several nodes share are
one (the least id stands for it), cells are halved twice a level where they hold more than ``LEAF`` places, and nowhere
else. So a dense town has small cells, far outliers cost a few levels, and no leaf holds more than ``LEAF`` places.

Clicks go down the tree together, a round a level, twice: first each into the nearest cell of every level, so that the
nearest place of one leaf is a bound; then into all cells that are not farther than this bound, most often one or two.
Only the few leaves that are left are looked into. A cell's children and a leaf's places are one row each, so that a
click meets them in its own row and nothing is sorted or gathered by click before the end. So a click never meets more
than ``LEAF`` places of a leaf, however nodes and clicks lie, and rounds are twice as many as the tree has levels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.functions.geo import degree_distance
from roamgrid.plans.lineage import Scratch, scratch, written
from roamgrid.region import Region

#: Places in a leaf, at most; children of a cell in each direction; halvings of the whole box, at most.
LEAF, FAN, DEEPEST = 32, 4, 40
#: Corners are computed in another way than cells: bounds are loosened by this share of the box's side.
LOOSE = 1e-12
#: Levels of at most a few thousand parents: every task has them.
FEW_LEVELS = 4


def nearest(nodes: DataFrame, lat: float, lng: float) -> DataFrame:
    """The nearest node of one point, a row of nodes with ``d2``, or none."""
    d2 = degree_distance(F.col("lat"), F.col("lng"), F.lit(float(lat)), F.lit(float(lng)))
    return nodes.withColumn("d2", d2).orderBy("d2", "id").limit(1)


def _number(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e6)


@dataclass(frozen=True)
class Index:
    """places(level, x, y, node_id, n_lat, n_lng) by leaf, sorted by it, and as one row for each leaf (``held``); for each level
    its cells(x, y, leaf); the box begins at (south, west), cells of level k have the side ``side / FAN ** k``."""

    places: DataFrame
    leaves: DataFrame
    cells: list[DataFrame]
    south: float
    west: float
    side: float

    def corner(self, level: int, x: Column, y: Column) -> tuple[Column, Column, float]:
        step = self.side / FAN**level
        return F.lit(self.south) + x * F.lit(step), F.lit(self.west) + y * F.lit(step), step


def build(nodes: DataFrame, leaf: int = LEAF) -> Index | None:
    """The tree over nodes(id, lat, lng) that have a place; None where none has."""
    places = nodes.where(_number("lat") & _number("lng")).groupBy(F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng")).agg(F.min("id").alias("node_id"))
    with scratch(nodes.sparkSession) as tables:
        places = tables.keep(places)
        box = places.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n_lat", "n_lng"))).first()
        if box["min_n_lat"] is None:
            return None
        south, west = box["min_n_lat"], box["min_n_lng"]
        # a little larger, so that no place lies on the far side
        side = max(box["max_n_lat"] - south, box["max_n_lng"] - west, 1e-9) * (1 + 1e-9)
        cells, leaves, level, open_ = [], [], 0, places
        while True:
            step = side / FAN**level
            number = lambda c, start, step=step: F.floor((F.col(c) - F.lit(start)) / F.lit(step)).cast("long")
            at = open_.withColumns({"x": number("n_lat", south), "y": number("n_lng", west)})
            last = FAN ** (level + 1) > 1 << DEEPEST
            counted = at.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("leaf", (F.col("n") <= leaf) | F.lit(last))
            own, counts = tables.keep_counted(counted, "x", "y", open=~F.col("leaf"))
            cells.append(own.select(F.lit(level).alias("level"), "x", "y", "leaf"))
            met = at.join(own.select("x", "y", "leaf"), ["x", "y"]).select(F.lit(level).alias("level"), "x", "y", "leaf", "node_id", "n_lat", "n_lng")
            if not counts["open"]:  # all that is left lies in leaves
                leaves.append(met)
                break
            met = tables.keep(met)
            leaves.append(met.where("leaf"))
            open_ = met.where("not leaf").select("node_id", "n_lat", "n_lng")
            level += 1
        every = reduce(DataFrame.unionByName, leaves).drop("leaf")
        all_cells = written(reduce(DataFrame.unionByName, cells))
        levels = [all_cells.where(F.col("level") == k).drop("level") for k in range(level + 1)]
        every = written(every.repartition("level", "x", "y").sortWithinPartitions("level", "x", "y"))
        held = every.groupBy("level", "x", "y").agg(F.collect_list(F.struct("n_lat", "n_lng", "node_id")).alias("held"))
        return Index(every, written(held), levels, south, west, side)


def _children(index: Index, level: int) -> DataFrame:
    """(px, py, below): the cells of a level by their parent, at most FAN * FAN of them as an array."""
    up = 1 if level == 0 else FAN  # the root is the only cell of its level
    parent = lambda c: F.floor(F.col(c) / up).cast("long").alias(f"p{c}")
    rows = index.cells[level].groupBy(parent("x"), parent("y")).agg(F.collect_list(F.struct("x", "y", "leaf")).alias("below"))
    # the upper levels have few cells, which very many clicks meet
    return F.broadcast(rows) if level <= FEW_LEVELS else rows


def _low(index: Index, level: int, cell: Column) -> Column:
    """How near a cell's places may be, squared."""
    south, west, step = index.corner(level, cell["x"], cell["y"])
    near = lambda c, start: F.greatest(F.greatest(start - F.col(c), F.col(c) - start - F.lit(step), F.lit(0.0)) - F.lit(index.side * LOOSE), F.lit(0.0))
    a, b = near("lat", south), near("lng", west)
    return a * a + b * b


def _down(tables: Scratch, clicks: DataFrame, index: Index, chosen: Callable[[int], Column]) -> DataFrame:
    """The clicks' rows at the leaves that they come to, where ``chosen`` takes some of the cells in ``below``."""
    zero = F.lit(0).cast("long")
    rows, leaves = clicks.withColumns({"px": zero, "py": zero}), []
    for level in range(len(index.cells)):
        met = rows.join(_children(index, level), ["px", "py"]).select(*clicks.columns, F.explode(chosen(level)).alias("c"))
        kept = tables.keep(met.select(*clicks.columns, "c.x", "c.y", "c.leaf"))
        leaves.append(kept.where("leaf").select(*clicks.columns, F.lit(level).alias("level"), "x", "y"))
        rows = kept.where("not leaf").select(*clicks.columns, F.col("x").alias("px"), F.col("y").alias("py"))
    return reduce(DataFrame.unionByName, leaves)


def _hit(index: Index, rows: DataFrame) -> DataFrame:
    """The rows with ``hit``, the nearest place of the leaf that each is at."""
    d2 = lambda x: degree_distance(F.col("lat"), F.col("lng"), x["n_lat"], x["n_lng"])
    nearest = F.array_min(F.transform("held", lambda x: F.struct(d2(x).alias("d2"), x["node_id"].alias("node_id"))))
    return rows.join(index.leaves, ["level", "x", "y"]).withColumn("hit", nearest).drop("held")


def _descend(tables: Scratch, clicks: DataFrame, index: Index) -> DataFrame:
    """(key, lat, lng, best, level, x, y): the leaves that may hold a click's nearest place, for clicks(key, lat, lng)."""
    asked = clicks.select("key", "lat", "lng")
    # first to one leaf, by the nearest cell of each level: its nearest place is a bound
    nearest = lambda level: F.array(F.array_min(F.transform("below", lambda c: F.struct(_low(index, level, c).alias("low"), c["x"].alias("x"), c["y"].alias("y"), c["leaf"].alias("leaf")))))
    bound = (F.col("hit.d2") * (1 + LOOSE)).alias("best")
    known = tables.keep(_hit(index, _down(tables, asked, index, nearest)).select("key", "lat", "lng", bound))
    return _down(tables, known, index, lambda level: F.filter("below", lambda c: _low(index, level, c) <= F.col("best")))


def snap(clicks: DataFrame, nodes: DataFrame | Index) -> DataFrame:
    """(click_id, node_id, d2) for clicks(click_id, lat, lng); no row where there are no nodes or a coordinate is null or no number.

    Equal clicks go down once. ``nodes`` may be an index made before.
    """
    asked = clicks.select("click_id", "lat", "lng").where(_number("lat") & _number("lng"))
    index = nodes if isinstance(nodes, Index) else build(nodes)
    if index is None:
        return asked.where(F.lit(False)).select("click_id", F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("double").alias("d2"))
    with scratch(clicks.sparkSession) as tables:
        points = tables.keep(asked.select("lat", "lng").distinct().withColumn("key", F.monotonically_increasing_id()))
        found = _descend(tables, points, index)
        hits = _hit(index, found).groupBy("lat", "lng").agg(F.min("hit").alias("hit")).select("lat", "lng", "hit.node_id", "hit.d2")
        return written(asked.join(hits, ["lat", "lng"]).select("click_id", "node_id", "d2"))


def snap_in_region(clicks: DataFrame, nodes: DataFrame | Index, region: Region) -> DataFrame:
    """Snap the clicks inside the region only: (click_id, inside, node_id, d2) for every click."""
    inside = F.coalesce(region.contains(F.col("lat"), F.col("lng")), F.lit(False))
    marked = clicks.select("click_id", "lat", "lng", inside.alias("inside"))
    hits = snap(marked.where("inside"), nodes)
    return marked.select("click_id", "inside").join(hits, "click_id", "left")
