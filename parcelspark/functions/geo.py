"""Planar-local geodesy on WGS84 as column expressions.

Distances use the ellipsoid's meridian and normal radii at the pair's mid
latitude; up to 20 km this stays within millimetres of the geodesic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.functions.numbers import round_even

# WGS84 ellipsoid.
SEMI_MAJOR_M = 6378137.0
ECCENTRICITY_SQ = 0.0066943799901413165
RADIAN = 0.017453292519943295
EARTH_KM = 6371.0  # mean radius used by the great-circle check

# Lowest latitude gives the shortest degree of latitude. The width of a cell fits
# the reference latitude: up to it the eight neighbours cover the radius, beyond
# it ``lon_reach`` tells how much further west and east to look.
_MERIDIAN_MIN_M = SEMI_MAJOR_M * (1.0 - ECCENTRICITY_SQ)
REFERENCE_LAT = 39.0


def _radii(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of longitude and of latitude at ``lat``."""
    phi = lat * F.lit(RADIAN)
    s = F.sin(phi)
    w = F.lit(1.0) - F.lit(ECCENTRICITY_SQ) * s * s
    normal = F.lit(SEMI_MAJOR_M) / F.sqrt(w)
    meridian = normal * F.lit(1.0 - ECCENTRICITY_SQ) / w
    return normal * F.cos(phi) * F.lit(RADIAN), meridian * F.lit(RADIAN)


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    kx, ky = _radii((lat1 + lat2) / F.lit(2.0))
    dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * ky
    return F.sqrt(dx * dx + dy * dy)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle kilometres on the mean sphere, three digits."""
    p1, p2 = lat1 * F.lit(RADIAN), lat2 * F.lit(RADIAN)
    sp = F.sin((p2 - p1) / 2.0)
    sl = F.sin((lon2 - lon1) * F.lit(RADIAN) / 2.0)
    h = sp * sp + F.cos(p1) * F.cos(p2) * sl * sl
    return round_even(F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(h)), 3)


def with_edge_distance(df: DataFrame, lon: str, lat: str, edge: str, metres: str, degrees: str | None = None) -> DataFrame:
    """Add the distance from a point to one line piece, optionally in plain
    degrees too (for callers that order by raw coordinates).

    Intermediate values are columns of their own: written as one expression the
    tree would repeat them hundreds of times and dominate planning.
    """
    e, x, y = F.col(edge), F.col(lon), F.col(lat)

    def foot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        t = F.try_divide(-(ax * bx + ay * by), bx * bx + by * by)
        return F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

    kx, ky = _radii(y)
    df = df.withColumns({
        "_kx": kx, "_ky": ky, "_dx": e["x1"] - x, "_dy": e["y1"] - y,
        "_ux": e["x2"] - e["x1"], "_uy": e["y2"] - e["y1"]})
    c = F.col
    df = df.withColumns({
        "_ax": c("_dx") * c("_kx"), "_ay": c("_dy") * c("_ky"), "_bx": c("_ux") * c("_kx"), "_by": c("_uy") * c("_ky")})
    df = df.withColumn("_t", foot(c("_ax"), c("_ay"), c("_bx"), c("_by")))
    df = df.withColumns({"_qx": e["x1"] + c("_t") * c("_ux"), "_qy": e["y1"] + c("_t") * c("_uy")})
    df = df.withColumn("_mid", (y + c("_qy")) / F.lit(2.0))
    mx, my = _radii(c("_mid"))
    df = df.withColumns({"_mx": (c("_qx") - x) * mx, "_my": (c("_qy") - y) * my})
    df = df.withColumn(metres, F.sqrt(c("_mx") * c("_mx") + c("_my") * c("_my")))
    if degrees:
        df = df.withColumn("_td", foot(c("_dx"), c("_dy"), c("_ux"), c("_uy")))
        df = df.withColumns({"_fx": c("_dx") + c("_td") * c("_ux"), "_fy": c("_dy") + c("_td") * c("_uy")})
        df = df.withColumn(degrees, F.sqrt(c("_fx") * c("_fx") + c("_fy") * c("_fy")))
    return df.drop(*[n for n in (
        "_kx _ky _dx _dy _ux _uy _ax _ay _bx _by _t _qx _qy _mid _mx _my _td _fx _fy").split()])


def edges_of(vertices: Column, closed: bool) -> Column:
    """Line pieces of a vertex array; a closed ring joins last to first."""
    following = F.slice(vertices, F.lit(2), F.size(vertices) - 1)
    if closed:
        following = F.concat(following, F.slice(vertices, 1, 1))
    starts = vertices if closed else F.slice(vertices, F.lit(1), F.size(vertices) - 1)
    return F.transform(
        F.arrays_zip(starts.alias("a"), following.alias("b")),
        lambda z: F.struct(
            z["a"]["lon"].alias("x1"), z["a"]["lat"].alias("y1"),
            z["b"]["lon"].alias("x2"), z["b"]["lat"].alias("y2"),
        ),
    )


def straddles_east(lon: Column, lat: Column, e: Column) -> Column:
    """Whether the eastward ray from the point crosses the edge."""
    x_at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
    return ((e["y1"] > lat) != (e["y2"] > lat)) & F.coalesce(lon < x_at, F.lit(False))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def crosses(e: Column, g: Column) -> Column:
    """Whether two line pieces cross, touching ends not counted."""
    d1 = _side(g["x1"], g["y1"], g["x2"], g["y2"], e["x1"], e["y1"])
    d2 = _side(g["x1"], g["y1"], g["x2"], g["y2"], e["x2"], e["y2"])
    d3 = _side(e["x1"], e["y1"], e["x2"], e["y2"], g["x1"], g["y1"])
    d4 = _side(e["x1"], e["y1"], e["x2"], e["y2"], g["x2"], g["y2"])
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def cell_size(radius_m: float, lat: float = REFERENCE_LAT) -> tuple[float, float]:
    """Degree width and height of a grid cell whose neighbours cover ``radius_m`` at ``lat``."""
    shortest = SEMI_MAJOR_M * math.cos(lat * RADIAN) * RADIAN
    return radius_m * 1.000001 / shortest, radius_m * 1.000001 / (_MERIDIAN_MIN_M * RADIAN)


def lon_reach(abs_lat: Column, radius_m: float, size: tuple[float, float]) -> Column:
    """Degrees of longitude that cover ``radius_m`` around shapes up to ``abs_lat``, a cell at least."""
    metres = F.cos(F.least(abs_lat + F.lit(size[1]), F.lit(90.0)) * F.lit(RADIAN)) * F.lit(SEMI_MAJOR_M * RADIAN)
    return F.least(F.greatest(F.lit(radius_m * 1.000001) / metres, F.lit(size[0])), F.lit(360.0))


def cell_of(lon: Column, lat: Column, size: tuple[float, float]) -> tuple[Column, Column]:
    return F.floor(lon / F.lit(size[0])).cast("int"), F.floor(lat / F.lit(size[1])).cast("int")
