"""Coordinates, distances and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelore import params as P


def encode_x(lon: Column) -> Column:
    """Degrees east to decimetres on the grid, rounded."""
    return ((lon - P.MIN_LON) * P.LON_SCALE + 0.5).cast("int")


def encode_y(lat: Column) -> Column:
    return ((lat - P.MIN_LAT) * P.LAT_SCALE + 0.5).cast("int")


def decode_lon(x: Column) -> Column:
    """Back to degrees; with encode_x a round trip is off by a decimetre at most."""
    return (x.cast("double") - 0.5) / P.LON_SCALE + P.MIN_LON


def decode_lat(y: Column) -> Column:
    return (y.cast("double") - 0.5) / P.LAT_SCALE + P.MIN_LAT


def is_valid(x: Column, y: Column) -> Column:
    return (x > 0) & (y > 0)


def _metres(a: Column, b: Column) -> Column:
    return F.call_function("div", F.abs(a.cast("long") - b.cast("long")) + 5, F.lit(10))


def distance_xy_squared(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared metres on the grid, each axis rounded to metres."""
    dx, dy = _metres(x1, x2), _metres(y1, y2)
    return dx * dx + dy * dy


def distance_xy(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.floor(F.sqrt(distance_xy_squared(x1, y1, x2, y2) + 0.5)).cast("long")


def squared_dm(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared decimetres."""
    dx, dy = x1.cast("long") - x2.cast("long"), y1.cast("long") - y2.cast("long")
    return dx * dx + dy * dy


def metres_of_squared_dm(d2: Column) -> Column:
    return F.floor(F.sqrt(d2.cast("double")) / 10 + 0.5).cast("long")


def distance_lat_lon(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres between grid points, by the spherical law of cosines."""
    a, b = F.radians(decode_lat(y1)), F.radians(decode_lat(y2))
    turn = F.radians(decode_lon(x1) - decode_lon(x2))
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(turn)
    d = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))) * 60 * P.MILE
    return F.when((x1 == x2) & (y1 == y2), F.lit(0)).otherwise(F.floor(d + 0.5)).cast("long")


def in_rings(x: Column, y: Column, rings: Column, holes: bool = False) -> Column:
    """Even-odd test: is the point inside a ring? Rings: array of arrays of (x, y).

    Holes count as inside; with holes they do not: then a point is inside if an odd number of rings holds it.
    """
    px, py = x.cast("long"), y.cast("long")

    def odd(ring: Column) -> Column:
        before = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
        # a's edge runs to the corner before it; it counts if it spans the point's height and meets it to the right
        crosses = lambda a, b: (a["y"] > py).eqNullSafe(b["y"] > py) == F.lit(False)
        meet = lambda a, b: (b["x"] - a["x"]) * (py - a["y"])
        edge = lambda a, b: crosses(a, b) & (px < a["x"] + _div(meet(a, b), b["y"] - a["y"]))
        return F.size(F.filter(F.zip_with(ring, before, edge), lambda hit: hit)) % 2 == 1

    return F.size(F.filter(rings, odd)) % 2 == 1 if holes else F.exists(rings, odd)


def _div(a: Column, b: Column) -> Column:
    """Division of longs toward zero; null where b is 0 (the edge then does not cross)."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def segment_distance_squared(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment, in squared units of the grid, rounded down."""
    px, py, ax, ay, bx, by = (c.cast("double") for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / long2))).otherwise(0.0)
    ex, ey = px - ax - t * dx, py - ay - t * dy
    return F.floor(ex * ex + ey * ey)


def tile_x(lon: Column, zoom: int) -> Column:
    """Column of the map tile that shows a longitude."""
    return F.floor((lon + 180.0) / 360.0 * float(1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    a = F.radians(lat)
    return F.floor((1.0 - F.log(F.tan(a) + 1.0 / F.cos(a)) / math.pi) / 2.0 * float(1 << zoom)).cast("long")
