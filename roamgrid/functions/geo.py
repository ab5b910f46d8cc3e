"""Distances, travel time and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roamgrid.region import Region

# The mean radius of the Earth and an average speed in town
EARTH_RADIUS_M = 6_371_000.0
SPEED_M_PER_HOUR = 30_000.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degree_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Squared distance in degrees, the metric of snapping."""
    return (lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2)


def travel_seconds(metres: Column) -> Column:
    """At the average speed, rounded half up."""
    return F.round(metres / F.lit(SPEED_M_PER_HOUR / 3600.0)).cast("long")


def kilometres(metres: Column) -> Column:
    """To one place, as a user sees it."""
    return F.round(metres / 1000, 1)


def minutes(seconds: Column) -> Column:
    return F.round(seconds / 60).cast("long")


def outside_text(region: Region, lat: Column, lng: Column) -> Column:
    return F.format_string(f"Point (%.5f, %.5f) lies outside {region.name.replace('%', '%%')}", lat, lng)


def no_route_text(source: Column, target: Column) -> Column:
    return F.format_string("No route from node %d to node %d", source, target)
