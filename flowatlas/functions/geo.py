"""Geometry as Column expressions: great-circle distance, equal-area projection, hexagon grid, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Ellipsoid and standard parallel of the cylindrical equal-area projection EPSG:6933.
A, INVERSE_FLATTENING, PARALLEL = 6378137.0, 298.257223563, 30.0
_F = 1 / INVERSE_FLATTENING
E2 = _F * (2 - _F)
E1 = math.sqrt(E2)
K0 = math.cos(math.radians(PARALLEL)) / math.sqrt(1 - E2 * math.sin(math.radians(PARALLEL)) ** 2)
#: Hexagons with the mean area of an H3 cell of resolution 8, and the offsets that make one id of two coordinates.
CELL_AREA = 737_327.6
SIDE = math.sqrt(2 * CELL_AREA / (3 * math.sqrt(3)))
OFFSET, SPAN = 2**20, 2**21
#: Steps from a cell to its neighbours.
NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    """x, y and z on the unit sphere, where neither poles nor the antimeridian are special."""
    p, q = F.radians(lat), F.radians(lon)
    return [F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)]


def project_x(lon: Column) -> Column:
    return F.radians(lon) * F.lit(A * K0)


def project_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    q = F.lit(1 - E2) * (s / (1 - E2 * s * s) - F.lit(1 / (2 * E1)) * F.ln((1 - E1 * s) / (1 + E1 * s)))
    return q * F.lit(A / (2 * K0))


def unproject_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(A * K0))


def unproject_lat(y: Column) -> Column:
    """Latitude of a projected y, by the series from the authalic latitude."""
    pole = 1 - (1 - E2) / (2 * E1) * math.log((1 - E1) / (1 + E1))
    b = F.asin(y * F.lit(2 * K0 / A / pole))
    series = [E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360]
    return F.degrees(b + sum((F.lit(c) * F.sin(2 * k * b) for k, c in enumerate(series, 1)), F.lit(0.0)))


def planar_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Projected metres, rounded to 2; 0 where an end is missing."""
    d = F.hypot(project_x(lon1) - project_x(lon2), project_y(lat1) - project_y(lat2))
    return F.coalesce(F.round(d, 2), F.lit(0.0))


def cell_id(q: Column, r: Column) -> Column:
    return ((q + OFFSET) * SPAN + (r + OFFSET)).cast("long")


def cell_q(cell: Column) -> Column:
    return F.shiftright(cell, 21) - OFFSET


def cell_r(cell: Column) -> Column:
    return cell % SPAN - OFFSET


def cell_of_plane(x: Column, y: Column) -> Column:
    """Cell of a projected point: pointy-top hexagons, axial coordinates, cube rounding."""
    q, r = (x * (math.sqrt(3) / 3) - y / 3) / SIDE, y * (2 / 3) / SIDE
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    first, second = (dq > dr) & (dq > ds), dr > ds
    return cell_id(F.when(first, -rr - rs).otherwise(rq).cast("long"), F.when(~first & second, -rq - rs).otherwise(rr).cast("long"))


def cell_of(lon: Column, lat: Column) -> Column:
    """Cell of a point in degrees; null where a coordinate is."""
    return cell_of_plane(project_x(lon), project_y(lat))


def centre_x(cell: Column) -> Column:
    return (cell_q(cell) + cell_r(cell) / 2) * F.lit(SIDE * math.sqrt(3))


def centre_y(cell: Column) -> Column:
    return cell_r(cell) * F.lit(SIDE * 1.5)


def around(cell: Column) -> Column:
    """The cell and its six neighbours."""
    return F.array(cell, *[cell + F.lit(dq * SPAN + dr) for dq, dr in NEIGHBOURS])


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a literal polygon: bounding box, then parity of crossings (half-open edges)."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
            inside = inside != (crosses & (x < F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1))
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


def in_ring_column(x: Column, y: Column, ring: Column) -> Column:
    """The same for a ring column, ARRAY<STRUCT<x, y>>."""
    n = F.size(ring)

    def toggle(state: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        crosses = (a["y"] > y) != (b["y"] > y)
        return state != (crosses & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(False), lambda s, i: F.coalesce(toggle(s, i), s))


def shoelace(ring: Column) -> Column:
    """Area of a ring column, ARRAY<STRUCT<x, y>>, in its own units."""
    n = F.size(ring)
    term = lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, i % n + 1)["y"] - F.element_at(ring, i % n + 1)["x"] * F.element_at(ring, i)["y"]
    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + term(i))) / 2
