"""Polygons as ARRAY<ARRAY<STRUCT<x, y>>>: the first ring is the shell, the others are holes.

Everything is built of higher-order functions over the rings' edges. A point on the border is not
in the polygon for `intersects`, but is at distance 0; for all other shapes the polygon is closed.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import geometry as g

RINGS = "array<array<struct<x:double,y:double>>>"


@dataclass
class Polygon:
    rings: Column

    @classmethod
    def of(cls, *rings: list[tuple[float, float]]) -> Polygon:
        """From rings of corners; each must be closed and have more than two corners."""
        for ring in rings:
            if len(ring) < 4 or ring[0] != ring[-1]:
                raise ValueError("a ring is closed and has three corners at least")
        return cls(F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]) for ring in rings]))

    def column(self) -> Column:
        return self.rings


def _edges(polygon: Polygon) -> Column:
    """The edges of all rings as structs a, b of corners."""

    def of_ring(ring: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda k: F.struct(F.get(ring, k).alias("a"), F.get(ring, k + 1).alias("b")))

    return F.flatten(F.transform(polygon.rings, of_ring))


def _ends(edge: Column) -> tuple[list[Column], list[Column]]:
    return [edge["a"]["x"], edge["a"]["y"]], [edge["b"]["x"], edge["b"]["y"]]


def on_border(point: list[Column], polygon: Polygon) -> Column:
    return F.exists(_edges(polygon), lambda e: g.on_segment(point, *_ends(e)))


def _crossings_odd(point: list[Column], polygon: Polygon) -> Column:
    """Even-odd rule: edges that a ray to the right crosses."""

    def crosses(e: Column) -> Column:
        (ax, ay), (bx, by) = _ends(e)
        return ((ay > point[1]) != (by > point[1])) & (point[0] < (bx - ax) * (point[1] - ay) / F.when(by != ay, by - ay) + ax)

    return F.size(F.filter(_edges(polygon), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def contains(polygon: Polygon, point: g.Point) -> Column:
    """Whether the point is in the interior."""
    known = g.known(point.coords) & polygon.rings.isNotNull()
    return F.when(known, _crossings_odd(point.coords, polygon) & ~on_border(point.coords, polygon))


def covers(polygon: Polygon, point: g.Point) -> Column:
    """Whether the point is in the interior or on the border."""
    known = g.known(point.coords) & polygon.rings.isNotNull()
    return F.when(known, _crossings_odd(point.coords, polygon) | on_border(point.coords, polygon))


def _first_corner(polygon: Polygon) -> g.Point:
    corner = F.get(F.get(polygon.rings, F.lit(0)), F.lit(0))
    return g.Point([corner["x"], corner["y"]])


def _as_polygon(box: g.Box) -> Polygon:
    (ax, ay), (bx, by) = box.low, box.high
    corners = [(ax, ay), (bx, ay), (bx, by), (ax, by), (ax, ay)]
    return Polygon(F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])))


def intersects_polygon(shape, polygon: Polygon) -> Column:
    kind = type(shape).__name__
    if kind == "Point":
        return contains(polygon, shape)
    if kind == "Circle":
        return distance_to_polygon(g.Point(shape.center), polygon) <= shape.radius
    if kind == "Segment":
        return F.exists(_edges(polygon), lambda e: g.segments_meet(*_ends(e), shape.start, shape.end)) | covers(polygon, g.Point(shape.start))
    other = _as_polygon(shape) if kind == "Box" else shape
    meet = F.exists(_edges(polygon), lambda e: F.exists(_edges(other), lambda f: g.segments_meet(*_ends(e), *_ends(f))))
    return meet | covers(polygon, _first_corner(other)) | covers(other, _first_corner(polygon))


def distance_to_polygon(shape, polygon: Polygon) -> Column:
    zero = F.lit(0.0)
    kind = type(shape).__name__
    if kind == "Point":
        return F.when(covers(polygon, shape), zero).otherwise(F.array_min(F.transform(_edges(polygon), lambda e: g.point_to_segment(shape.coords, *_ends(e)))))
    if kind == "Circle":
        away = distance_to_polygon(g.Point(shape.center), polygon) - shape.radius
        return F.when(away > 0, away).when(away.isNotNull(), zero)
    if kind == "Segment":
        return F.when(intersects_polygon(shape, polygon), zero).otherwise(F.array_min(F.transform(_edges(polygon), lambda e: g.segment_to_segment(*_ends(e), shape.start, shape.end))))
    other = _as_polygon(shape) if kind == "Box" else shape
    nearest = F.array_min(F.transform(_edges(polygon), lambda e: F.array_min(F.transform(_edges(other), lambda f: g.segment_to_segment(*_ends(e), *_ends(f))))))
    return F.when(intersects_polygon(other, polygon), zero).otherwise(nearest)


def box_of_polygon(polygon: Polygon) -> g.Box:
    corners = F.flatten(polygon.rings)
    xs, ys = F.transform(corners, lambda c: c["x"]), F.transform(corners, lambda c: c["y"])
    return g.Box([F.array_min(xs), F.array_min(ys)], [F.array_max(xs), F.array_max(ys)])


def to_wkt(polygon: Polygon) -> Column:
    def ring(r: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(r, lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))), ", "), F.lit(")"))

    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(polygon.rings, ring), ", "), F.lit(")"))


def from_wkt(text: Column) -> Polygon:
    """The polygon of a WKT string; null for other geometries."""
    body = F.regexp_extract(text, r"(?i)^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$", 1)

    def corner(c: Column) -> Column:
        parts = F.split(F.trim(c), r"\s+")
        return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))

    rings = F.transform(F.split(body, r"\)\s*,\s*\("), lambda r: F.transform(F.split(r, ","), corner))
    return Polygon(F.when(body != "", rings))


def encode_wkb(rings: list[list[dict]]) -> bytes:
    """Well-known binary, little-endian."""
    parts = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        parts.append(struct.pack("<I", len(ring)))
        parts += [struct.pack("<dd", c["x"], c["y"]) for c in ring]
    return b"".join(parts)


def decode_wkb(data: bytes | None) -> list[list[dict]] | None:
    """The rings of a WKB polygon of either byte order; None for other geometries."""
    if not data or len(data) < 9:
        return None
    order = "<" if data[0] == 1 else ">"
    kind, n = struct.unpack_from(f"{order}II", data, 1)
    if kind != 3:
        return None
    at, rings = 9, []
    for _ in range(n):
        (m,) = struct.unpack_from(f"{order}I", data, at)
        numbers = struct.unpack_from(f"{order}{2 * m}d", data, at + 4)
        rings.append([{"x": x, "y": y} for x, y in zip(numbers[::2], numbers[1::2], strict=True)])
        at += 4 + 16 * m
    return rings


def _encode_column(rings: pa.Array) -> pa.Array:
    return pa.array([None if r is None else encode_wkb(r) for r in rings.to_pylist()], pa.binary())


_ARROW_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _decode_column(data: pa.Array) -> pa.Array:
    return pa.array([decode_wkb(d) for d in data.to_pylist()], _ARROW_RINGS)


def to_wkb(polygon: Polygon) -> Column:
    return F.arrow_udf(_encode_column, "binary")(polygon.rings)


def from_wkb(data: Column) -> Polygon:
    return Polygon(F.arrow_udf(_decode_column, RINGS)(data))
