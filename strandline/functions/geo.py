"""Geometry as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
EARTH_RADIUS_KM = 6371.0
METERS_PER_DEG_LAT = 111194.9
REGIONAL_REF_LAT = 43.5
REGIONAL_REF_LON = 35.0
REGIONAL_METERS_PER_DEG_LON = 87300.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres (G1)."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + half_lon * half_lon * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def meters_per_deg_lon(ref_lat: Column) -> Column:
    """Local length of a degree of longitude, with a guard at the poles."""
    scale = F.lit(METERS_PER_DEG_LAT) * F.cos(F.radians(ref_lat))
    return F.when(F.abs(scale) < 1e-9, F.lit(METERS_PER_DEG_LAT)).otherwise(scale)


def regional_xy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Fixed regional projection in metres."""
    return (
        (lon - REGIONAL_REF_LON) * REGIONAL_METERS_PER_DEG_LON,
        (lat - REGIONAL_REF_LAT) * METERS_PER_DEG_LAT,
    )


def length2d(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null, although least and greatest skip nulls."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """Unit vector; the zero vector stays zero."""
    size = length2d(x, y)
    return (
        F.when(size == 0, F.lit(0.0)).otherwise(x / size),
        F.when(size == 0, F.lit(0.0)).otherwise(y / size),
    )


def bearing_unit(deg: Column) -> tuple[Column, Column]:
    """Unit vector of a compass bearing, clockwise from north."""
    return F.sin(F.radians(deg)), F.cos(F.radians(deg))


def rotate(x: Column, y: Column, rad: Column) -> tuple[Column, Column]:
    return x * F.cos(rad) - y * F.sin(rad), x * F.sin(rad) + y * F.cos(rad)


def segment_distance_sq(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    span = dx * dx + dy * dy
    t = F.when(span == 0, F.lit(0.0)).otherwise(
        clamp(((px - ax) * dx + (py - ay) * dy) / span, 0.0, 1.0)
    )
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def orientation(a, b, c) -> Column:
    """Twice the signed area of a triangle of (lat, lon) structs."""
    return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])


def safe_ratio(value: Column, base: Column) -> Column:
    """Zero when the base is zero."""
    return F.coalesce(F.try_divide(value, base), F.lit(0.0))


def ring_key(value: Column) -> Column:
    """Coordinate identity at six decimals."""
    return F.round(value, 6)


TWO_PI = 2 * math.pi
