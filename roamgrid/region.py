"""The served region: a named bounding box."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def box_text(south: Column, west: Column, north: Column, east: Column) -> Column:
    """``south,west,north,east`` to six places, as map services take it."""
    return F.format_string("%.6f,%.6f,%.6f,%.6f", south, west, north, east)


def described(south: Column, north: Column, west: Column, east: Column) -> list[Column]:
    """center and bbox."""
    center = F.struct(((south + north) / 2).alias("lat"), ((west + east) / 2).alias("lng"))
    return [center.alias("center"), F.struct(south.alias("south"), north.alias("north"), west.alias("west"), east.alias("east")).alias("bbox")]


def boxes(places: DataFrame, *names: str) -> DataFrame:
    """(names, center, bbox, box) of the least box around the places(names, lat, lng) of each name; none where a name has no whole place."""
    whole = places.where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")
    ends = whole.groupBy(*names).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))
    south, north, west, east = (F.col(x) for x in ("south", "north", "west", "east"))
    return ends.select(*names, *described(south, north, west, east), box_text(south, west, north, east).alias("box"))


@dataclass(frozen=True)
class Region:
    name: str
    south: float
    north: float
    west: float
    east: float

    def contains(self, lat: Column, lng: Column) -> Column:
        """Inclusive on all sides; NaN is outside."""
        return lat.between(self.south, self.north) & lng.between(self.west, self.east)

    def _sides(self) -> tuple[Column, ...]:
        return tuple(F.lit(float(x)) for x in (self.south, self.north, self.west, self.east))

    def box_text(self) -> Column:
        south, north, west, east = self._sides()
        return box_text(south, west, north, east)

    def describe(self, spark: SparkSession) -> DataFrame:
        """One row: name, center, bbox."""
        return spark.range(1).select(F.lit(self.name).alias("name"), *described(*self._sides()))


# Fixed values of the served region
REGION = Region("Rajahmundry", 16.96, 17.01, 81.76, 81.82)
