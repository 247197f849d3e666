"""Distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_METRES = 6_371_000.0


def valid_position(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M1: great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M2: planar distance in degrees."""
    return F.hypot(lat1 - lat2, lon1 - lon2)


def parse_position(c: Column) -> Column:
    """M3: 'lat,lng' text, or an array text '[lng,lat]', as a checked struct."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    plain, listed = rf"^\s*{number}\s*,\s*{number}\s*$", rf"^\s*\[\s*{number}\s*,\s*{number}\s*\]\s*$"
    lat = F.when(c.rlike(plain), F.regexp_extract(c, plain, 1)).when(c.rlike(listed), F.regexp_extract(c, listed, 2)).cast("double")
    lon = F.when(c.rlike(plain), F.regexp_extract(c, plain, 2)).when(c.rlike(listed), F.regexp_extract(c, listed, 1)).cast("double")
    return F.when(valid_position(lat, lon), F.struct(lat.alias("lat"), lon.alias("lng")))
