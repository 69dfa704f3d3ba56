"""Distances as Column expressions (F1, F2, F12 helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M_PER_DEG = 111_320.0
EARTH_R_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def metres(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular metres with the cosine of the middle latitude."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dy = (lat2 - lat1) * F.lit(M_PER_DEG)
    dx = (lon2 - lon1) * F.lit(M_PER_DEG) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dp = F.radians(lat2 - lat1) / 2
    dl = F.radians(lon2 - lon1) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) * F.sin(dl)
    return F.lit(2 * EARTH_R_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def arc_metres(lat1, lon1, lat2, lon2) -> Column:
    """Radian form: R * sqrt(dphi^2 + (cos(mid) dlambda)^2)."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dy = F.radians(lat2 - lat1)
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(EARTH_R_M) * F.sqrt(dx * dx + dy * dy)


def degree_sq(lat1, lon1, lat2, lon2) -> Column:
    """Plain squared degrees, the older nearest-stop measure."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def project(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Local (x, y) metres about an origin."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    x = (lon - lon0) * F.lit(M_PER_DEG) * F.cos(F.radians(lat0))
    y = (lat - lat0) * F.lit(M_PER_DEG)
    return x, y


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Compass bearing of the chord in degrees, 0 = north."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dy = lat2 - lat1
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def point_to_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """(distance, fraction along) of a point to a segment in metres."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - ax) * dx + (py - ay) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey), t


def polyline_metres(path: str | Column) -> Column:
    """Length of ARRAY<STRUCT<lat,lon>> by pairing each vertex with the next."""
    p = _c(path)
    n = F.size(p)
    pairs = F.arrays_zip(F.slice(p, F.lit(1), n - 1).alias("a"), F.slice(p, F.lit(2), n - 1).alias("b"))
    total = F.aggregate(
        pairs,
        F.lit(0.0),
        lambda acc, x: acc + metres(x["a"]["lat"], x["a"]["lon"], x["b"]["lat"], x["b"]["lon"]),
    )
    return F.when(n >= 2, total).otherwise(F.lit(0.0))
