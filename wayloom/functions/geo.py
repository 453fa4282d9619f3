"""Geometry on degrees as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radius in metres, decimals of a quantised degree, squared length of a degenerate segment.
RADIUS = 6_371_000.0
QUANTUM = 1e5
DEGENERATE = 1e-18


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane scaled at the mean latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.lit(RADIUS) * F.sqrt(x * x + y * y)


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(v, high))


def rounded(v: Column, digits: int) -> Column:
    """A double rounded half away from zero as SQL engines scale it: by the binary product, not by the decimals it prints as."""
    scaled = F.abs(v) * F.lit(10.0**digits)
    whole = F.floor(scaled)
    up = F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole)
    return F.when(scaled < 2.0**52, F.signum(v) * up / F.lit(10.0**digits)).otherwise(v)  # larger ones have no fraction


def quantize(degrees: Column) -> Column:
    """Degrees as an integer, rounded half away from zero."""
    return F.round(degrees * F.lit(QUANTUM), 0).cast("int")


def project(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column, Column]:
    """(t, lat, lon) of the nearest point of a segment, planar in degrees, t in [0, 1]."""
    dy, dx = lat2 - lat1, lon2 - lon1
    size = dy * dy + dx * dx
    t = F.when(size < DEGENERATE, F.lit(0.0)).otherwise(clamp(((lat - lat1) * dy + (lon - lon1) * dx) / size, F.lit(0.0), F.lit(1.0)))
    return t, lat1 + t * dy, lon1 + t * dx


def box_distance_sq(lat: Column, lon: Column, lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    """Squared degrees from a point to a box; 0 inside."""
    dy, dx = lat - clamp(lat, lat_min, lat_max), lon - clamp(lon, lon_min, lon_max)
    return dy * dy + dx * dx


def travel_seconds(metres: Column, kmh: Column) -> Column:
    return metres * F.lit(3.6) / kmh
