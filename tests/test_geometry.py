"""Golden cases of the geometry algebra."""

import math

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.functions import polygon as poly


def P(*xs):
    return g.Point.of(*xs)


def M(low, high):
    return g.Box.of(low, high)


def C(center, r):
    return g.Circle.of(center, r)


def S(a, b):
    return g.Segment.of(a, b)


def Y(text):
    ring = [tuple(map(float, c.split(","))) for c in text.split()]
    return poly.Polygon.of([*ring, ring[0]])


R2, R5 = math.sqrt(2), math.sqrt(5)
TRIANGLE, UPPER = "-1,-1 1,-1 0,1", "0,0 2,0 1,2"


def cases():
    return [
        (P(0, 0), P(1, 1), False, R2),
        (P(1, 1), P(1, 1), True, 0),
        (P(0, 0), M((-2, 1), (-1, 2)), False, R2),
        (P(0, 0), M((-1, -1), (0, 0)), True, 0),
        (P(0, 0), M((-1, -1), (1, 1)), True, 0),
        (P(0, 0), C((2, 0), 1), False, 1),
        (P(0, 0), C((1, 0), 1), True, 0),
        (P(0, 0), C((0, 0), 1), True, 0),
        (P(0, 0), S((1, 1), (2, 1)), False, R2),
        (P(0, 0), S((0, 0), (1, 0)), True, 0),
        (P(0, 0), S((-1, 0), (1, 0)), True, 0),
        (P(0, 0), Y(TRIANGLE), True, 0),
        (P(0, 0), Y("0,0 4,0 3,2"), False, 0),  # on the border
        (P(0, 0), Y("1,-1 2,1 1,1"), False, 1),
        (M((0, 0), (2, 2)), M((1, 1), (3, 3)), True, 0),
        (M((0, 0), (2, 2)), M((2, 0), (3, 1)), True, 0),
        (M((0, 0), (2, 2)), M((1, 3), (2, 4)), False, 1),
        (M((0, 0), (2, 2)), P(1, 1), True, 0),
        (M((0, 0), (2, 2)), P(3, 0), False, 1),
        (M((0, 0), (2, 2)), S((1, 1), (3, 2)), True, 0),
        (M((0, 0), (2, 2)), S((1, 3), (3, 1)), True, 0),
        (M((0, 0), (2, 2)), S((3, 3), (4, 2)), False, R2),
        (M((0, 0), (2, 2)), S((0.5, 0.5), (1, 1)), True, 0),  # strictly inside
        (M((0, 0), (2, 2)), C((2, 1), 1), True, 0),
        (M((0, 0), (2, 2)), C((3, 3), R2), True, 0),
        (M((0, 0), (2, 2)), C((4, 1), 1), False, 1),
        (M((0, 0), (2, 2)), Y(TRIANGLE), True, 0),
        (M((0, 0), (2, 2)), Y("-2,-1 0,-1 0,1"), True, 0),
        (M((0, 0), (2, 2)), Y("2,-1 3,-1 3,0"), False, R2 / 2),
        (C((-2, 0), 2), C((-1.5, 0), 0.5), True, 0),
        (C((-2, 0), 2), C((0, 1), 1), True, 0),
        (C((-2, 0), 2), C((1, 0), 1), True, 0),
        (C((-2, 0), 2), C((2, 1), 1), False, math.sqrt(17) - 3),
        (C((0, 0), 1), P(0.5, 0), True, 0),
        (C((0, 0), 1), P(1.5, 0), False, 0.5),
        (C((0, 0), 1), S((0, 0), (1, 1)), True, 0),
        (C((0, 0), 1), S((1, 0), (1, 1)), True, 0),
        (C((0, 0), 1), S((2, 0), (1, 1)), False, R2 - 1),
        (C((0, 0), 1), M((1, 0), (2, 1)), True, 0),
        (C((0, 0), 1), M((2, 0), (3, 1)), False, 1),
        (C((0, 0), 1), Y("1,0 2,0 2,1"), True, 0),
        (C((0, 0), 1), Y("2,0 3,0 3,1"), False, 1),
        (S((-1, 0), (1, 1)), S((0, 0), (0, 2)), True, 0),
        (S((-1, 0), (1, 1)), S((1, 0), (1, 2)), True, 0),
        (S((-1, 0), (1, 1)), S((2, 0), (2, 2)), False, 1),
        (S((-1, 0), (1, 1)), P(0, 0.5), True, 0),
        (S((-1, 0), (1, 1)), P(1, 0), False, 2 / R5),
        (S((-1, 0), (1, 1)), M((-2, -1), (0, 2)), True, 0),
        (S((-1, 0), (1, 1)), M((-2, -1), (-1, 0)), True, 0),
        (S((-1, 0), (1, 1)), M((1, -1), (2, 0)), False, 2 / R5),
        (S((-1, 0), (1, 1)), C((0.25, 0), R5 / 4 + 1e-12), True, 0),
        (S((-1, 0), (1, 1)), C((2, 0), 1), False, R2 - 1),
        (S((-1, 0), (1, 1)), Y("0,-1 1,-1 1,1"), True, 0),
        (S((-1, 0), (1, 1)), Y("1,0 2,0 2,1"), False, R2 / 2),
        (Y(TRIANGLE), Y(UPPER), True, 0),
        (Y(TRIANGLE), Y("-1,1 1,1 0,3"), True, 0),
        (Y(TRIANGLE), Y("1,0 2,0 2,1"), False, 1 / R5),
        (Y(UPPER), P(1, 1), True, 0),
        (Y(UPPER), P(1.5, 1), False, 0),  # on the border
        (Y(UPPER), P(2, 1), False, 1 / R5),
        (Y(UPPER), S((1, 1), (2, 1)), True, 0),
        (Y(UPPER), S((0, 2), (2, 2)), True, 0),
        (Y(UPPER), S((3, 0), (3, 2)), False, 1),
        (Y(UPPER), C((1, -1), 1), True, 0),
        (Y(UPPER), C((4, 0), 1), False, 1),
        (Y(UPPER), M((0, 2), (2, 4)), True, 0),
        (Y(UPPER), M((3, 0), (4, 1)), False, 1),
        (P(-1, 0), C((0, -1), 1), False, R2 - 1),
        (P(1, 2, 3), P(1, 2, 5), False, 2),
        (P(5), M((1,), (3,)), False, 2),
    ]


def test_pairs_both_ways(spark):
    one = spark.range(1)
    all_cases, got = cases(), []
    for k in range(0, len(all_cases), 8):
        columns = []
        for i, (a, b, _, _) in enumerate(all_cases[k : k + 8]):
            a, b = (a, b) if i % 2 else (b, a)  # the order of the two doesn't matter
            columns += [g.intersects(a, b).alias(f"i{i}"), g.min_dist(a, b).alias(f"d{i}")]
        row = one.select(*columns).first()
        got += [(row[f"i{i}"], row[f"d{i}"]) for i in range(len(all_cases[k : k + 8]))]
    for (a, b, meets, apart), (i, d) in zip(all_cases, got, strict=True):
        assert i == meets, (a, b)
        assert d == pytest.approx(apart, abs=1e-8), (a, b)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    box = M((0, 0), (2, 2))
    assert value(spark, g.area(box)) == 4
    assert value(spark, g.overlap_ratio(box, M((1, 1), (3, 3)))) == 0.25
    assert value(spark, g.overlap_ratio(box, M((2, 0), (3, 1)))) == 0
    for point, far in (((1, 1), R2), ((0, 0), math.sqrt(8)), ((1, 3), math.sqrt(10))):
        assert value(spark, g.max_dist(box, P(*point))) == pytest.approx(far)
    assert value(spark, g.shift(P(0, 0), 1).column()) == [1, 1]
    assert value(spark, g.not_above(P(0, 0), P(1, 1))) and not value(spark, g.not_above(P(1, 1), P(0, 0)))
    assert value(spark, g.centroid(box).column()) == [1, 1]
    for shape, low, high in ((C((0, 0), 1), [-1, -1], [1, 1]), (S((-1, 1), (1, 0)), [-1, 0], [1, 1]), (Y(UPPER), [0, 0], [2, 2]), (P(0, 0), [0, 0], [0, 0])):
        found = value(spark, g.box_of(shape).column())
        assert (found["low"], found["high"]) == (low, high)
    assert value(spark, g.to_text(P(1, 2))) == "POINT(1.0,2.0)"
    assert value(spark, g.to_text(box)) == "BOX(0.0,0.0;2.0,2.0)"


def test_z_value(spark):
    z = g.z_value([F.lit(x) for x in (2, 0, 1, 6)], 3)
    assert value(spark, z) == 0b110010010
    assert value(spark, F.array(*g.z_parts(z, 4, 3))) == [2, 0, 1, 6]
    assert value(spark, g.padded_bits(F.lit(7), 8)) == "00000111"


def test_polygon_with_a_hole(spark):
    square = poly.Polygon.of([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)])
    assert value(spark, g.intersects(P(1, 1), square))
    assert not value(spark, g.intersects(P(4, 4), square))
    assert value(spark, g.min_dist(P(4.5, 4), square)) == 1
    assert not value(spark, g.intersects(S((4, 4), (5, 5)), square))


def test_wkt_and_wkb(spark):
    corners = [(2, 1), (3, 0), (4, 1), (3, 2)]
    diamond = poly.from_wkt(F.lit("POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*corners, corners[0]]) + "))"))
    written = "POLYGON ((" + ", ".join(f"{x:.1f} {y:.1f}" for x, y in [*corners, corners[0]]) + "))"
    assert value(spark, g.min_dist(P(2, 0), diamond)) == pytest.approx(R2 / 2)
    assert value(spark, poly.from_wkt(F.lit("POINT (0 0)")).rings) is None
    assert value(spark, poly.to_wkt(diamond)) == written
    again = spark.range(1).select(poly.to_wkb(diamond).alias("b")).select(poly.to_wkt(poly.from_wkb(F.col("b"))).alias("v")).first()["v"]
    assert again == written
    assert poly.decode_wkb(b"\x01\x01\x00\x00\x00" + bytes(16)) is None


def test_bad_shapes():
    with pytest.raises(ValueError):
        M((1, 1), (0, 2))
    with pytest.raises(ValueError):
        g.Segment.of((1, 2, 3), (1, 2, 3))
    with pytest.raises(ValueError):
        poly.Polygon.of([(0, 0), (1, 1), (0, 0)])


def test_null_coordinates(spark):
    nothing = g.Point([F.lit(None).cast("double"), F.lit(1.0)])
    assert not value(spark, g.intersects(nothing, M((0, 0), (2, 2))))
    assert value(spark, g.min_dist(nothing, P(0, 0))) is None
