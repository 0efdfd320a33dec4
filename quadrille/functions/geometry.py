"""Points, boxes, circles and segments over plain columns.

A shape here is a small Python object that holds coordinate Columns, so every function expands to
arithmetic that stays inside whole-stage code generation. Points and boxes have any dimension,
segments two. The metric is Euclidean; distances are the square root of a left-to-right sum of
products, so that other engines reproduce them bit by bit.

Columns store shapes as ARRAY<DOUBLE> (point), STRUCT<low, high> (box), STRUCT<center, radius>
(circle), STRUCT<start, end> (segment) and ARRAY<ARRAY<STRUCT<x, y>>> (polygon, see polygon.py).
A null coordinate makes a predicate null and a distance null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def as_column(x: Number | str) -> Column:
    """A Column of doubles from a Column, a column's name or a number."""
    if isinstance(x, Column):
        return x.cast("double")
    return F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x))


def _columns(xs) -> list[Column]:
    return [as_column(x) for x in xs]


@dataclass
class Point:
    coords: list[Column]

    @classmethod
    def of(cls, *xs: Number | str) -> Point:
        return cls(_columns(xs))

    @classmethod
    def from_array(cls, array: Column | str, dims: int) -> Point:
        array = F.col(array) if isinstance(array, str) else array
        return cls([F.get(array, F.lit(k)).cast("double") for k in range(dims)])

    def column(self) -> Column:
        return F.array(*self.coords)


@dataclass
class Box:
    low: list[Column]
    high: list[Column]

    @classmethod
    def of(cls, low, high) -> Box:
        """From two corners; corners given as numbers must be in order."""
        if len(low) != len(high):
            raise ValueError("the corners of a box have different dimensions")
        if any(isinstance(a, (int, float)) and isinstance(b, (int, float)) and a > b for a, b in zip(low, high, strict=True)):
            raise ValueError("a box's low corner is above its high corner")
        return cls(_columns(low), _columns(high))

    def column(self) -> Column:
        return F.struct(F.array(*self.low).alias("low"), F.array(*self.high).alias("high"))

    def edges(self) -> list[Segment]:
        (ax, ay), (bx, by) = self.low, self.high
        corners = [(ax, ay), (bx, ay), (bx, by), (ax, by)]
        return [Segment(list(corners[k]), list(corners[(k + 1) % 4])) for k in range(4)]


@dataclass
class Circle:
    center: list[Column]
    radius: Column

    @classmethod
    def of(cls, center, radius: Number | str) -> Circle:
        return cls(_columns(center), as_column(radius))

    def column(self) -> Column:
        return F.struct(F.array(*self.center).alias("center"), self.radius.alias("radius"))


@dataclass
class Segment:
    start: list[Column]
    end: list[Column]

    @classmethod
    def of(cls, start, end) -> Segment:
        if len(start) != 2 or len(end) != 2:
            raise ValueError("a segment has two dimensions")
        return cls(_columns(start), _columns(end))

    def column(self) -> Column:
        return F.struct(F.array(*self.start).alias("start"), F.array(*self.end).alias("end"))


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _same_dims(a: list, b: list) -> None:
    if len(a) != len(b):
        raise ValueError(f"shapes of {len(a)} and {len(b)} dimensions")


def distance(a: list[Column], b: list[Column]) -> Column:
    _same_dims(a, b)
    return F.sqrt(_sum([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]))


def _gap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    return F.when(other_high < low, low - other_high).when(other_low > high, other_low - high).otherwise(F.when(low.isNotNull() & other_low.isNotNull(), F.lit(0.0)))


def _box_gap(low: list[Column], high: list[Column], other_low: list[Column], other_high: list[Column]) -> Column:
    _same_dims(low, other_low)
    gaps = [_gap(a, b, c, d) for a, b, c, d in zip(low, high, other_low, other_high, strict=True)]
    return F.sqrt(_sum([g * g for g in gaps]))


def turn(p: list[Column], q: list[Column], r: list[Column]) -> Column:
    """The sign of the turn p -> q -> r: 0 on one line."""
    return F.signum((q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1]))


def _in_span(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    return _all([(x >= F.least(s, e)) & (x <= F.greatest(s, e)) for x, s, e in zip(p, a, b, strict=True)])


def on_segment(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    return (turn(a, b, p) == 0) & _in_span(p, a, b)


def segments_meet(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> Column:
    crossing = (turn(a, b, c) != turn(a, b, d)) & (turn(c, d, a) != turn(c, d, b))
    return crossing | on_segment(c, a, b) | on_segment(d, a, b) | on_segment(a, c, d) | on_segment(b, c, d)


def point_to_segment(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / square))
    return F.when(square == 0, distance(p, a)).otherwise(distance(p, [a[0] + t * dx, a[1] + t * dy]))


def segment_to_segment(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> Column:
    ends = F.least(point_to_segment(a, c, d), point_to_segment(b, c, d), point_to_segment(c, a, b), point_to_segment(d, a, b))
    return F.when(segments_meet(a, b, c, d), F.lit(0.0)).otherwise(ends)


_ORDER = ["Point", "Box", "Circle", "Segment", "Polygon"]


def _ordered(a, b):
    return (a, b) if _ORDER.index(type(a).__name__) <= _ORDER.index(type(b).__name__) else (b, a)


def intersects(a, b) -> Column:
    """Whether two shapes meet; closed shapes, but a polygon's border does not hold a point."""
    a, b = _ordered(a, b)
    pair = (type(a).__name__, type(b).__name__)
    if pair[1] == "Polygon":
        from quadrille.functions import polygon

        return polygon.intersects_polygon(a, b)
    if pair == ("Point", "Point"):
        _same_dims(a.coords, b.coords)
        return _all([x == y for x, y in zip(a.coords, b.coords, strict=True)])
    if pair == ("Point", "Box"):
        _same_dims(a.coords, b.low)
        return _all([x.between(lo, hi) for x, lo, hi in zip(a.coords, b.low, b.high, strict=True)])
    if pair == ("Point", "Circle"):
        return distance(a.coords, b.center) <= b.radius
    if pair == ("Point", "Segment"):
        return on_segment(a.coords, b.start, b.end)
    if pair == ("Box", "Box"):
        _same_dims(a.low, b.low)
        return _all([(lo <= hi2) & (hi >= lo2) for lo, hi, lo2, hi2 in zip(a.low, a.high, b.low, b.high, strict=True)])
    if pair == ("Box", "Circle"):
        return min_dist(Point(b.center), a) <= b.radius
    if pair == ("Box", "Segment"):
        inside = intersects(Point(b.start), a)
        return inside | _any([segments_meet(e.start, e.end, b.start, b.end) for e in a.edges()])
    if pair == ("Circle", "Circle"):
        return distance(a.center, b.center) <= a.radius + b.radius
    if pair == ("Circle", "Segment"):
        return point_to_segment(a.center, b.start, b.end) <= a.radius
    return segments_meet(a.start, a.end, b.start, b.end)


def min_dist(a, b) -> Column:
    """The smallest distance between two shapes, 0 where they meet."""
    a, b = _ordered(a, b)
    pair = (type(a).__name__, type(b).__name__)
    if pair[1] == "Polygon":
        from quadrille.functions import polygon

        return polygon.distance_to_polygon(a, b)
    zero = F.lit(0.0)
    if pair == ("Point", "Point"):
        return distance(a.coords, b.coords)
    if pair == ("Point", "Box"):
        return _box_gap(b.low, b.high, a.coords, a.coords)
    if pair == ("Point", "Circle"):
        return _not_below(distance(a.coords, b.center) - b.radius)
    if pair == ("Point", "Segment"):
        return point_to_segment(a.coords, b.start, b.end)
    if pair == ("Box", "Box"):
        return _box_gap(a.low, a.high, b.low, b.high)
    if pair == ("Box", "Circle"):
        return _not_below(min_dist(Point(b.center), a) - b.radius)
    if pair == ("Box", "Segment"):
        return F.when(intersects(a, b), zero).otherwise(F.least(*[segment_to_segment(e.start, e.end, b.start, b.end) for e in a.edges()]))
    if pair == ("Circle", "Circle"):
        return _not_below(distance(a.center, b.center) - a.radius - b.radius)
    if pair == ("Circle", "Segment"):
        return _not_below(point_to_segment(a.center, b.start, b.end) - a.radius)
    return segment_to_segment(a.start, a.end, b.start, b.end)


def _not_below(x: Column) -> Column:
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def max_dist(box: Box, point: Point) -> Column:
    """From a point to the box's furthest corner."""
    sides = [F.greatest(F.abs(x - lo), F.abs(hi - x)) for x, lo, hi in zip(point.coords, box.low, box.high, strict=True)]
    return F.sqrt(_sum([s * s for s in sides]))


def area(box: Box) -> Column:
    """The box's volume in its dimension."""
    return reduce(lambda a, b: a * b, [hi - lo for lo, hi in zip(box.low, box.high, strict=True)])


def overlap_ratio(box: Box, query: Box) -> Column:
    """The share of the box that the query covers; 0 where they only touch or are apart."""
    _same_dims(box.low, query.low)
    sides = [F.least(hi, hi2) - F.greatest(lo, lo2) for lo, hi, lo2, hi2 in zip(box.low, box.high, query.low, query.high, strict=True)]
    common = reduce(lambda a, b: a * b, sides)
    return F.when(_all([s > 0 for s in sides]), common / area(box)).when(common.isNotNull(), F.lit(0.0))


def centroid(box: Box) -> Point:
    return Point([(lo + hi) / 2 for lo, hi in zip(box.low, box.high, strict=True)])


def box_of(shape) -> Box:
    """The smallest box around a shape."""
    kind = type(shape).__name__
    if kind == "Point":
        return Box(shape.coords, shape.coords)
    if kind == "Box":
        return shape
    if kind == "Circle":
        return Box([c - shape.radius for c in shape.center], [c + shape.radius for c in shape.center])
    if kind == "Segment":
        return Box([F.least(a, b) for a, b in zip(shape.start, shape.end, strict=True)], [F.greatest(a, b) for a, b in zip(shape.start, shape.end, strict=True)])
    from quadrille.functions import polygon

    return polygon.box_of_polygon(shape)


def shift(point: Point, by: Number) -> Point:
    return Point([x + as_column(by) for x in point.coords])


def not_above(a: Point, b: Point) -> Column:
    """a <= b in every dimension."""
    _same_dims(a.coords, b.coords)
    return _all([x <= y for x, y in zip(a.coords, b.coords, strict=True)])


def to_text(shape) -> Column:
    """POINT(x,y), BOX(..;..), CIRCLE(..;r), SEGMENT(..->..), or a polygon's WKT."""

    def join(xs: list[Column]) -> Column:
        return F.concat_ws(",", *[x.cast("string") for x in xs])

    kind = type(shape).__name__
    if kind == "Point":
        return F.concat(F.lit("POINT("), join(shape.coords), F.lit(")"))
    if kind == "Box":
        return F.concat(F.lit("BOX("), join(shape.low), F.lit(";"), join(shape.high), F.lit(")"))
    if kind == "Circle":
        return F.concat(F.lit("CIRCLE("), join(shape.center), F.lit(";"), shape.radius.cast("string"), F.lit(")"))
    if kind == "Segment":
        return F.concat(F.lit("SEGMENT("), join(shape.start), F.lit("->"), join(shape.end), F.lit(")"))
    from quadrille.functions import polygon

    return polygon.to_wkt(shape)


def known(coords: list[Column]) -> Column:
    """Neither null nor NaN in any coordinate."""
    return _all([x.isNotNull() & ~F.isnan(x) for x in coords])


def z_value(values: list[Column], bits: int) -> Column:
    """Interleaves the low `bits` of each integer column, the first one foremost, to a long."""
    d = len(values)
    if bits * d > 63:
        raise ValueError("a z-value has 63 bits")
    terms = [F.shiftleft(F.shiftright(v.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * d + (d - 1 - j)) for b in range(bits) for j, v in enumerate(values)]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def z_parts(z: Column, dims: int, bits: int) -> list[Column]:
    """The integers that z_value has interleaved."""
    return [
        reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(z.cast("long"), b * dims + (dims - 1 - j)).bitwiseAND(F.lit(1).cast("long")), b) for b in range(bits)])
        for j in range(dims)
    ]


def padded_bits(value: Column, width: int) -> Column:
    return F.lpad(F.bin(value.cast("long")), width, "0")
