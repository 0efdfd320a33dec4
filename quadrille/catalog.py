"""The registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.functions import polygon as poly
from quadrille.functions import sql as sql_functions
from quadrille.operators import filters, joins, partition
from quadrille.plans.predicates import And, InBox, InCircle, InKnn, Leaf, Not, Or
from quadrille.plans.storage import checkpoint_folder
from quadrille.sources.index import Registry

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a function (spark, table) -> DataFrame, where table(name) reads a table."""

    def register(f):
        def run(spark, sf_dir):
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def parts(table):
    return table("part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"))


def customers(table):
    return table("customer").select("c_custkey", (F.col("c_custkey") % 53).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))


XY = ["x", "y"]
P = "(SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice - 900::DOUBLE AS y FROM part)"
C = "(SELECT c_custkey, (c_custkey % 53)::DOUBLE AS x, c_acctbal / 100::DOUBLE AS y FROM customer)"
D = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y))"


def to(x, y):
    """The distance of a point (x, y) in SQL."""
    return f"sqrt((x - {x}::DOUBLE) * (x - {x}::DOUBLE) + (y - {y}::DOUBLE) * (y - {y}::DOUBLE))"


# Range, circle and nearest neighbours


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 920 AND 960")
def range_2d(spark, table):
    return filters.range_query(table("part"), ["p_size", "p_retailprice"], [10, 920], [20, 960]).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def range_1d(spark, table):
    return filters.range_query(table("orders"), ["o_totalprice"], [100000], [150000]).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 20000 AND 30000 AND l_suppkey BETWEEN 1 AND 40")
def range_3d(spark, table):
    return filters.range_query(table("lineitem"), ["l_quantity", "l_extendedprice", "l_suppkey"], [10, 20000, 1], [20, 30000, 40]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT p_brand, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_size BETWEEN 5 AND 25 AND p_retailprice BETWEEN 910 AND 990 GROUP BY p_brand")
def range_agg_by_brand(spark, table):
    rows = filters.range_query(table("part"), ["p_size", "p_retailprice"], [5, 910], [25, 990])
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query(f"SELECT p_partkey, x, y FROM {P} WHERE {to(25, 50)} <= 12")
def circle_range_2d(spark, table):
    return filters.circle_range(parts(table), XY, [25, 50], 12)


@query(f"SELECT p_partkey, x, y FROM {P} WHERE {to(25, 50)} <= 12 AND {to(30, 55)} <= 12")
def circle_conj(spark, table):
    return filters.circles(parts(table), XY, [([25, 50], 12), ([30, 55], 12)])


@query(f"SELECT p_partkey, x, y FROM {P} WHERE x BETWEEN 20 AND 30 AND y BETWEEN 40 AND 60 AND NOT {to(25, 50)} <= 5")
def circle_not(spark, table):
    return filters.range_query(parts(table), XY, [20, 40], [30, 60]).where(~g.intersects(g.Point.of(*XY), g.Circle.of([25, 50], 5)))


@query(f"SELECT p_partkey, x, y, {to(25, 50)} AS d FROM {P} ORDER BY d, p_partkey LIMIT 10")
def knn_2d(spark, table):
    return filters.knn(parts(table), XY, [25, 50], 10, ["p_partkey"], dist_col="d")


@query(f"SELECT p_partkey, x, y FROM (SELECT *, rank() OVER (ORDER BY abs(x - 25::DOUBLE)) AS rk FROM {P}) WHERE rk <= 5")
def knn_ties_rank(spark, table):
    return filters.knn(parts(table), ["x"], [25], 5, keep_ties=True)


@query(f"SELECT * FROM (SELECT p_partkey, x, y FROM {P} ORDER BY {to(25, 50)}, p_partkey LIMIT 50) WHERE x > 25")
def knn_then_filter(spark, table):
    return filters.knn(parts(table), XY, [25, 50], 50, ["p_partkey"]).where("x > 25")


@query(f"SELECT p_partkey, x, y FROM {P} WHERE x > 25 ORDER BY {to(25, 50)}, p_partkey LIMIT 50")
def filter_then_knn(spark, table):
    return filters.knn(parts(table).where("x > 25"), XY, [25, 50], 50, ["p_partkey"])


_NEAR = f"(SELECT p_partkey, x, y FROM {P} ORDER BY {to(25, 50)}, p_partkey LIMIT 50)"
_BOX = f"(SELECT p_partkey, x, y FROM {P} WHERE x BETWEEN 24 AND 40 AND y BETWEEN 40 AND 55)"


def _near_and_box(table):
    rows = parts(table)
    return rows, filters.knn(rows, XY, [25, 50], 50, ["p_partkey"]), filters.range_query(rows, XY, [24, 40], [40, 55])


@query(f"SELECT * FROM {_NEAR} INTERSECT SELECT * FROM {_BOX}")
def knn_and_range(spark, table):
    _, near, box = _near_and_box(table)
    return filters.both(near, box)


@query(f"SELECT * FROM {_NEAR} UNION SELECT * FROM {_BOX}")
def knn_or_range(spark, table):
    _, near, box = _near_and_box(table)
    return filters.either(near, box)


@query(f"SELECT * FROM {P} EXCEPT SELECT * FROM {_NEAR}")
def not_knn(spark, table):
    rows, near, _ = _near_and_box(table)
    return filters.without(rows, near)


@query(f"SELECT * FROM {_NEAR} INTERSECT SELECT * FROM (SELECT p_partkey, x, y FROM {P} ORDER BY {to(28, 52)}, p_partkey LIMIT 50)")
def knn_intersect_knn(spark, table):
    rows, near, _ = _near_and_box(table)
    return filters.both(near, filters.knn(rows, XY, [28, 52], 50, ["p_partkey"]))


@query("SELECT vec_id, label FROM embeddings ORDER BY sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), vec_id LIMIT 20")
def knn_64d_embeddings(spark, table):
    return filters.knn(table("embeddings"), g.Point.from_array("embedding", 64), [0.0] * 64, 20, ["vec_id"]).select("vec_id", "label")


# Joins


@query(f"SELECT p_partkey, c_custkey, {D} AS d FROM {P} l JOIN {C} r ON {D} <= 1")
def distance_join_2d(spark, table):
    return joins.distance_join(parts(table), customers(table), XY, XY, 1.0, dist_col="d").select("p_partkey", "c_custkey", "d")


@query(f"SELECT p_partkey, c_custkey FROM {P} l JOIN {C} r ON {D} <= 1")
def distance_join_nested_loop(spark, table):
    return joins.distance_join(parts(table), customers(table), XY, XY, 1.0, "nested_loop").select("p_partkey", "c_custkey")


def _points(df, name):
    return df.select(df.columns[0], F.array("x", "y").alias(name))


@query(f"SELECT p_partkey, c_custkey FROM {P} l JOIN {C} r ON {D} <= 0.7")
def distance_join_points(spark, table):
    return joins.distance_join(_points(parts(table), "at"), _points(customers(table), "at"), ("at", 2), ("at", 2), 0.7).select("p_partkey", "c_custkey")


def solids(table):
    p = table("part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"), (F.col("p_partkey") % 17).cast("double").alias("z"))
    c = table("customer").select("c_custkey", (F.col("c_custkey") % 53).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"), (F.col("c_nationkey") % 17).cast("double").alias("z"))
    return p, c


D3 = "sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z))"


@query(f"""SELECT p_partkey, c_custkey FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice - 900::DOUBLE AS y, (p_partkey % 17)::DOUBLE AS z FROM part) l
JOIN (SELECT c_custkey, (c_custkey % 53)::DOUBLE AS x, c_acctbal / 100::DOUBLE AS y, (c_nationkey % 17)::DOUBLE AS z FROM customer) r ON {D3} <= 2""")
def distance_join_3d(spark, table):
    p, c = solids(table)
    return joins.distance_join(p, c, ["x", "y", "z"], ["x", "y", "z"], 2.0).select("p_partkey", "c_custkey")


@query(f"SELECT l.p_partkey AS a, r.p_partkey AS b FROM {P} l JOIN {P} r ON {D} <= 0.5 AND l.p_partkey < r.p_partkey")
def distance_self_join(spark, table):
    pairs = joins.distance_join(parts(table), parts(table), XY, XY, 0.5)
    return pairs.where("p_partkey_l < p_partkey_r").select(F.col("p_partkey_l").alias("a"), F.col("p_partkey_r").alias("b"))


@query(f"SELECT p_partkey, count(*) AS n FROM {P} l JOIN {C} r ON {D} <= 1 GROUP BY p_partkey")
def distance_join_count_per_left(spark, table):
    return joins.distance_join(parts(table), customers(table), XY, XY, 1.0).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey FROM {P} l WHERE EXISTS (SELECT 1 FROM {C} r WHERE {D} <= 0.5)")
def distance_semi_join(spark, table):
    return joins.distance_join(parts(table), customers(table), XY, XY, 0.5, how="left_semi").select("p_partkey")


@query(f"SELECT p_partkey FROM {P} l WHERE NOT EXISTS (SELECT 1 FROM {C} r WHERE {D} <= 0.5)")
def distance_anti_join(spark, table):
    return joins.distance_join(parts(table), customers(table), XY, XY, 0.5, how="left_anti").select("p_partkey")


def knn_sql(k, left=P, right=C, where=""):
    return f"SELECT p_partkey, c_custkey, d FROM (SELECT p_partkey, c_custkey, r.y AS ry, {D} AS d, row_number() OVER (PARTITION BY p_partkey ORDER BY {D}, c_custkey) AS n FROM {left} l CROSS JOIN {right} r) WHERE n <= {k}{where}"


def _knn(table, k, strategy="auto", right=None):
    return joins.knn_join(parts(table), customers(table) if right is None else right, XY, XY, k, ["c_custkey"], strategy, dist_col="d")


@query(knn_sql(3))
def knn_join_k3(spark, table):
    return _knn(table, 3).select("p_partkey", "c_custkey", "d")


@query(knn_sql(1))
def knn_join_k1(spark, table):
    return _knn(table, 1).select("p_partkey", "c_custkey", "d")


@query(knn_sql(3))
def knn_join_grid(spark, table):
    return _knn(table, 3, "grid").select("p_partkey", "c_custkey", "d")


@query(knn_sql(2))
def knn_join_points(spark, table):
    pairs = joins.knn_join(_points(parts(table), "here"), _points(customers(table), "there"), ("here", 2), ("there", 2), 2, ["c_custkey"], dist_col="d")
    return pairs.select("p_partkey", "c_custkey", "d")


@query(knn_sql(2, right=f"(SELECT * FROM {C} WHERE y > 50)"))
def knn_join_prefiltered_right(spark, table):
    return _knn(table, 2, right=customers(table).where("y > 50")).select("p_partkey", "c_custkey", "d")


@query(knn_sql(3, where=" AND ry > 50"))
def knn_join_postfilter(spark, table):
    return _knn(table, 3).where("y_r > 50").select("p_partkey", "c_custkey", "d")


@query(f"SELECT x, round(avg(d), 6) AS mean FROM (SELECT l.x AS x, {D} AS d, row_number() OVER (PARTITION BY p_partkey ORDER BY {D}, c_custkey) AS n FROM {P} l CROSS JOIN {C} r) WHERE n <= 3 GROUP BY x")
def knn_join_avg_dist(spark, table):
    return _knn(table, 3).groupBy(F.col("x_l").alias("x")).agg(F.round(F.avg("d"), 6).alias("mean"))


@query()
def zknn_join(spark, table):
    return joins.zknn_join(parts(table), customers(table), XY, XY, 3, ["c_custkey"], dist_col="d").select("p_partkey", "c_custkey", "d")


@query(f"SELECT 3 * count(*) AS pairs, true AS recall_at_least_90 FROM {P}")
def zknn_join_recall(spark, table):
    """How many pairs the approximate join gives, and whether nine tenths of the distances are those of the exact one."""
    found = zknn_join(spark, table).withColumn("n", F.row_number().over(Window.partitionBy("p_partkey").orderBy("d")))
    exact = _knn(table, 3).select("p_partkey", F.col("d").alias("best"), F.row_number().over(Window.partitionBy("p_partkey").orderBy("d")).alias("n"))
    both = found.join(exact, ["p_partkey", "n"])
    return both.agg(F.count("*").alias("pairs"), (F.avg((F.col("d") <= F.col("best") + 1e-9).cast("double")) >= 0.9).alias("recall_at_least_90"))


@query(knn_sql(3))
def knn_join_voronoi(spark, table):
    return _knn(table, 3, "voronoi").select("p_partkey", "c_custkey", "d")


@query(knn_sql(2))
def knn_join_block(spark, table):
    return _knn(table, 2, "block").select("p_partkey", "c_custkey", "d")


@query(f"SELECT p_partkey, c_custkey FROM {P} l JOIN {C} r ON {D} <= 1")
def distance_join_block(spark, table):
    return joins.distance_join(parts(table), customers(table), XY, XY, 1.0, "block").select("p_partkey", "c_custkey")


@query(f"SELECT p_partkey, c_custkey, d FROM {P} p LEFT JOIN (SELECT p_partkey AS k, c_custkey, {D} AS d FROM {P} l JOIN {C} r ON {D} <= 0.5) ON p_partkey = k")
def distance_outer_join(spark, table):
    return joins.distance_join(parts(table), customers(table), XY, XY, 0.5, dist_col="d", how="left").select("p_partkey", "c_custkey", "d")


# Geometry


def supplier_boxes(table):
    y = F.col("s_acctbal") / 100
    return table("supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("lx"), y.alias("ly"), (F.col("s_nationkey") + 3).cast("double").alias("hx"), (y + 10).alias("hy"))


B = "(SELECT s_suppkey, s_nationkey::DOUBLE AS lx, s_acctbal / 100::DOUBLE AS ly, (s_nationkey + 3)::DOUBLE AS hx, s_acctbal / 100::DOUBLE + 10 AS hy FROM supplier)"
BOX = lambda: g.Box.of(["lx", "ly"], ["hx", "hy"])


@query(f"SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {B} a JOIN {B} b ON a.s_suppkey < b.s_suppkey AND a.lx <= b.hx AND a.hx >= b.lx AND a.ly <= b.hy AND a.hy >= b.ly")
def mbr_intersects_join(spark, table):
    box = lambda c: g.Box.of([c("lx"), c("ly")], [c("hx"), c("hy")])
    pairs = joins.shape_join(supplier_boxes(table), supplier_boxes(table), box, box)
    return pairs.where("s_suppkey_l < s_suppkey_r").select(F.col("s_suppkey_l").alias("a"), F.col("s_suppkey_r").alias("b"))


@query(f"SELECT s_suppkey, c_custkey FROM {B} JOIN {C} ON sqrt(greatest(lx - x, 0.0::DOUBLE, x - hx) * greatest(lx - x, 0.0::DOUBLE, x - hx) + greatest(ly - y, 0.0::DOUBLE, y - hy) * greatest(ly - y, 0.0::DOUBLE, y - hy)) <= 2")
def box_circle_join(spark, table):
    pairs = joins.shape_join(supplier_boxes(table), customers(table), lambda c: g.Box.of([c("lx"), c("ly")], [c("hx"), c("hy")]), lambda c: g.Circle.of([c("x"), c("y")], 2))
    return pairs.select("s_suppkey", "c_custkey")


@query(f"SELECT s_suppkey FROM {B} WHERE lx <= 12 AND hx >= 5 AND ly <= 60 AND hy >= 20")
def range_on_shapes(spark, table):
    return filters.range_query(supplier_boxes(table), BOX(), [5, 20], [12, 60]).select("s_suppkey")


@query(f"SELECT s_suppkey FROM {B} WHERE sqrt(greatest(lx - 10.0::DOUBLE, 0.0::DOUBLE, 10.0::DOUBLE - hx) * greatest(lx - 10.0::DOUBLE, 0.0::DOUBLE, 10.0::DOUBLE - hx) + greatest(ly - 30.0::DOUBLE, 0.0::DOUBLE, 30.0::DOUBLE - hy) * greatest(ly - 30.0::DOUBLE, 0.0::DOUBLE, 30.0::DOUBLE - hy)) <= 6")
def circle_on_shapes(spark, table):
    return filters.circle_range(supplier_boxes(table), BOX(), [10, 30], 6).select("s_suppkey")


@query(f"SELECT s_suppkey, (hx - lx) * (hy - ly) AS area, CASE WHEN least(hx, 15.0::DOUBLE) > greatest(lx, 5.0::DOUBLE) AND least(hy, 60.0::DOUBLE) > greatest(ly, 20.0::DOUBLE) THEN (least(hx, 15.0::DOUBLE) - greatest(lx, 5.0::DOUBLE)) * (least(hy, 60.0::DOUBLE) - greatest(ly, 20.0::DOUBLE)) / ((hx - lx) * (hy - ly)) ELSE 0.0::DOUBLE END AS ratio FROM {B}")
def mbr_area_ratio(spark, table):
    return supplier_boxes(table).select("s_suppkey", g.area(BOX()).alias("area"), g.overlap_ratio(BOX(), g.Box.of([5, 20], [15, 60])).alias("ratio"))


def _max(x, lo, hi):
    return f"greatest(abs({x}::DOUBLE - {lo}), abs({hi} - {x}::DOUBLE))"


@query(f"SELECT s_suppkey, sqrt({_max(10, 'lx', 'hx')} * {_max(10, 'lx', 'hx')} + {_max(30, 'ly', 'hy')} * {_max(30, 'ly', 'hy')}) AS far FROM {B}")
def mbr_max_dist(spark, table):
    return supplier_boxes(table).select("s_suppkey", g.max_dist(BOX(), g.Point.of(10, 30)).alias("far"))


def _side(x, lo, hi):
    return f"greatest({lo} - {x}::DOUBLE, 0.0::DOUBLE, {x}::DOUBLE - {hi})"


@query(f"SELECT s_suppkey, sqrt({_side(10, 'lx', 'hx')} * {_side(10, 'lx', 'hx')} + {_side(30, 'ly', 'hy')} * {_side(30, 'ly', 'hy')}) AS d FROM {B}")
def point_mbr_min_dist(spark, table):
    return supplier_boxes(table).select("s_suppkey", g.min_dist(g.Point.of(10, 30), BOX()).alias("d"))


@query(f"SELECT c_custkey, {to(20, 40)} <= 2.0::DOUBLE + 5.0::DOUBLE AS meets, greatest({to(20, 40)} - 2.0::DOUBLE - 5.0::DOUBLE, 0.0::DOUBLE) AS d FROM {C}")
def circle_circle(spark, table):
    own, other = g.Circle.of(["x", "y"], 2), g.Circle.of([20, 40], 5)
    return customers(table).select("c_custkey", g.intersects(own, other).alias("meets"), g.min_dist(own, other).alias("d"))


_T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - 5.0::DOUBLE) * 40.0::DOUBLE + (y - 10.0::DOUBLE) * 70.0::DOUBLE) / 6500.0::DOUBLE))"


@query(f"SELECT c_custkey, round(sqrt((x - (5.0::DOUBLE + {_T} * 40.0::DOUBLE)) * (x - (5.0::DOUBLE + {_T} * 40.0::DOUBLE)) + (y - (10.0::DOUBLE + {_T} * 70.0::DOUBLE)) * (y - (10.0::DOUBLE + {_T} * 70.0::DOUBLE))), 9) AS d FROM {C}")
def segment_point_dist(spark, table):
    return customers(table).select("c_custkey", F.round(g.min_dist(g.Point.of("x", "y"), g.Segment.of((5, 10), (45, 80))), 9).alias("d"))


@query("""SELECT s_suppkey, (sign((80.0 - 10.0) * (x - 45.0) - (45.0 - 5.0) * (y - 80.0)) <> sign((80.0 - 10.0) * (x + 10 - 45.0) - (45.0 - 5.0) * (y - 80.0))
  AND sign((y - y) * (5.0 - (x + 10)) - 10 * (10.0 - y)) <> sign((y - y) * (45.0 - (x + 10)) - 10 * (80.0 - y))) AS meets
FROM (SELECT s_suppkey, s_nationkey::DOUBLE AS x, s_acctbal / 100::DOUBLE AS y FROM supplier)""")
def segment_intersects(spark, table):
    s = table("supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    return s.select("s_suppkey", g.intersects(g.Segment.of((5, 10), (45, 80)), g.Segment.of((F.col("x"), F.col("y")), (F.col("x") + 10, F.col("y")))).alias("meets"))


#: A convex polygon, counter-clockwise.
RING = [(10, 10), (40, 20), (45, 60), (20, 80), (10, 10)]
_HALVES = " AND ".join(f"({bx - ax}.0 * (y - {ay}.0) - {by - ay}.0 * (x - {ax}.0)) > 0" for (ax, ay), (bx, by) in zip(RING, RING[1:], strict=False))


@query(f"SELECT c_custkey, x, y FROM {C} WHERE {_HALVES}")
def point_in_polygon(spark, table):
    shape = poly.Polygon.of(RING)
    box = filters.range_query(customers(table), XY, [10, 10], [45, 80])
    return box.where(g.intersects(g.Point.of(*XY), shape))


HOLE = [(22, 30), (30, 30), (30, 40), (22, 40), (22, 30)]


def _edge_distance(ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - {ax}.0::DOUBLE) * {dx}.0::DOUBLE + (y - {ay}.0::DOUBLE) * {dy}.0::DOUBLE) / {dx * dx + dy * dy}.0::DOUBLE))"
    gap_x, gap_y = f"(x - ({ax}.0::DOUBLE + {t} * {dx}.0::DOUBLE))", f"(y - ({ay}.0::DOUBLE + {t} * {dy}.0::DOUBLE))"
    return f"sqrt({gap_x} * {gap_x} + {gap_y} * {gap_y})"


_BORDER = f"least({', '.join(_edge_distance(*a, *b) for ring in (RING, HOLE) for a, b in zip(ring, ring[1:], strict=False))})"
_IN_SHAPE = f"({_HALVES} AND NOT (x > 22 AND x < 30 AND y > 30 AND y < 40))"


@query(f"SELECT c_custkey, round(CASE WHEN {_IN_SHAPE} THEN 0.0::DOUBLE ELSE {_BORDER} END, 9) AS d, {_IN_SHAPE} OR {_BORDER} <= 3 AS near FROM {C}")
def polygon_distances(spark, table):
    shape = poly.Polygon.of(RING, HOLE)
    return customers(table).select("c_custkey", F.round(g.min_dist(g.Point.of(*XY), shape), 9).alias("d"), g.intersects(g.Circle.of(["x", "y"], 3), shape).alias("near"))


@query("SELECT c_nationkey, min(c_custkey % 53)::DOUBLE AS lx, min(c_acctbal) AS ly, max(c_custkey % 53)::DOUBLE AS hx, max(c_acctbal) AS hy FROM customer GROUP BY c_nationkey")
def extent_by_group(spark, table):
    box = g.box_of(g.Point.of((F.col("c_custkey") % 53), "c_acctbal"))
    (lx, ly), (hx, hy) = box.low, box.high
    return table("customer").groupBy("c_nationkey").agg(F.min(lx).alias("lx"), F.min(ly).alias("ly"), F.max(hx).alias("hx"), F.max(hy).alias("hy"))


@query(f"SELECT floor(x / 5)::BIGINT AS cx, floor(y / 10)::BIGINT AS cy, count(*) AS n FROM {C} GROUP BY 1, 2")
def grid_density(spark, table):
    return customers(table).groupBy(F.floor(F.col("x") / 5).cast("long").alias("cx"), F.floor(F.col("y") / 10).cast("long").alias("cy")).agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(cx, -1) AS cx, coalesce(cy, -99) AS cy, count(*) AS n FROM (SELECT floor(x / 10)::BIGINT AS cx, floor(y / 25)::BIGINT AS cy FROM {C}) GROUP BY CUBE (cx, cy)")
def grid_cube(spark, table):
    cells = customers(table).select(F.floor(F.col("x") / 10).cast("long").alias("cx"), F.floor(F.col("y") / 25).cast("long").alias("cy"))
    return cells.cube("cx", "cy").agg(F.count("*").alias("n")).select(F.coalesce("cx", F.lit(-1)).alias("cx"), F.coalesce("cy", F.lit(-99)).alias("cy"), "n")


_Z = " | ".join(f"(((p_size >> {b}) & 1)::BIGINT << {2 * b + 1}) | (((p_partkey >> {b}) & 1)::BIGINT << {2 * b})" for b in range(6))


@query(f"SELECT p_partkey, {_Z} AS z FROM part")
def zvalue_encode(spark, table):
    return table("part").select("p_partkey", g.z_value([F.col("p_size"), F.col("p_partkey")], 6).alias("z"))


@query("SELECT p_partkey, p_brand, rk FROM (SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rk FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 920 AND 980) WHERE rk <= 3")
def range_rank_window(spark, table):
    rows = filters.range_query(table("part"), ["p_size", "p_retailprice"], [10, 920], [30, 980])
    by_price = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    return rows.withColumn("rk", F.rank().over(by_price)).where("rk <= 3").select("p_partkey", "p_brand", "rk")


# Keys and indexes


@query("SELECT DISTINCT p_size, count(*) OVER (PARTITION BY p_size) AS n, count(*) OVER (ORDER BY p_size) AS rank FROM part")
def treap_rank(spark, table):
    return filters.ranks(table("part"), "p_size")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def treap_count(spark, table):
    return filters.ranks(table("part"), "p_size").select("p_size", "n")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 12 AND 17")
def index_range_treap(spark, table):
    index = Registry(spark).create(table("part"), "treap", "by_size", ["p_size"], 4)
    return index.range([12], [17]).select("p_partkey", "p_size")


@query(f"SELECT p_partkey, x, y FROM {P} WHERE x BETWEEN 10 AND 20 AND y BETWEEN 20 AND 60")
def index_range_rtree(spark, table):
    return Registry(spark).create(parts(table), "rtree", "by_place", XY, 16).range([10, 20], [20, 60])


@query(f"SELECT p_partkey, x, y FROM {P} WHERE {to(25, 50)} <= 8")
def index_circle_quadtree(spark, table):
    return Registry(spark).create(parts(table), "quadtree", "by_place", XY, 16).circle([25, 50], 8)


@query(f"SELECT p_partkey, x, y FROM {P} ORDER BY {to(25, 50)}, p_partkey LIMIT 7")
def index_knn_rtree(spark, table):
    return Registry(spark).create(parts(table), "rtree", "by_place", XY, 16).knn([25, 50], 7, ["p_partkey"])


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 17")
def index_eq_hash(spark, table):
    return Registry(spark).create(table("part"), "hashmap", "by_size", ["p_size"], 4).equals(17).select("p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 3 AND 4")
def index_range_dup_keys(spark, table):
    return Registry(spark).create(table("lineitem"), "treemap", "by_quantity", ["l_quantity"], 8).range([3], [4]).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT p_partkey, x, y FROM {P} WHERE x BETWEEN 10 AND 20 AND y BETWEEN 20 AND 60")
def index_persisted(spark, table):
    registry = Registry(spark)
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    index = registry.create(parts(table), "rtree", "by_place", XY, 16)
    registry.persist(index.table, "by_place", folder)
    registry.drop(index.table, "by_place")
    return registry.load(folder, "loaded").range([10, 20], [20, 60])


@query(f"SELECT p_partkey, x, y FROM {P} WHERE (x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 60 AND {to(25, 50)} <= 15) OR (y > 80 AND NOT x > 12)")
def index_mixed_predicates(spark, table):
    keys = tuple(XY)
    both = And(InBox(keys, (10, 20), (30, 60)), InCircle(keys, (25, 50), 15))
    return Registry(spark).create(parts(table), "rtree", "by_place", XY, 16).where(Or(both, And(Leaf("y", ">", 80), Not(Leaf("x", ">", 12)))))


@query(f"SELECT * FROM {_NEAR} WHERE x BETWEEN 24 AND 40 AND y BETWEEN 40 AND 55")
def index_knn_in_range(spark, table):
    keys = tuple(XY)
    near = InKnn(keys, (25, 50), 50, ("p_partkey",))
    return Registry(spark).create(parts(table), "rtree", "by_place", XY, 16).where(And(near, InBox(keys, (24, 40), (40, 55))))


@query(f"SELECT count(*) AS n FROM {P} WHERE {to(25, 50)} <= 18")
def index_circle_count(spark, table):
    n = Registry(spark).create(parts(table), "rtree", "by_place", XY, 16).circle_count([25, 50], 18)
    return spark.createDataFrame([(n,)], "n long")


@query(f"SELECT p_partkey, x, y FROM {P} WHERE x BETWEEN 5 AND 15 AND y BETWEEN 10 AND 40")
def range_through_an_index(spark, table):
    registry = Registry(spark)
    registry.create(parts(table), "rtree", "by_place", XY, 16)
    return registry.range(parts(table), XY, [5, 10], [15, 40])


@query(f"SELECT p_partkey, x, y FROM {P} WHERE x > 10 AND y <= 20")
def sql_on_index(spark, table):
    Registry(spark).create(parts(table), "rtree", "by_place", XY, 16).rows().createOrReplaceTempView("indexed_parts")
    return spark.sql("SELECT p_partkey, x, y FROM indexed_parts WHERE x > 10 AND y <= 20")


@query(f"SELECT c_custkey, {to(20, 40)} AS d FROM {C} WHERE x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 60 AND {to(20, 40)} <= 9")
def sql_functions_query(spark, table):
    sql_functions.register(spark)
    customers(table).createOrReplaceTempView("customer_points")
    return spark.sql("SELECT c_custkey, q_dist(x, y, 20, 40) AS d FROM customer_points WHERE q_in_box(x, y, 10, 20, 30, 60) AND q_in_circle(x, y, 20, 40, 9)")


# Partitioners: what each tile holds


def _balance(tiled, tiles):
    """Rows and tiles, and whether each tile has half to twice its share at most (few different keys allow no more)."""
    counts = tiled.groupBy("tile").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n"), F.count("*").alias("tiles"), (F.max("n") <= 2 * F.sum("n") / tiles).alias("even"))


@query(f"SELECT count(*) AS n, 16 AS tiles, true AS even FROM {P}")
def str_partition(spark, table):
    return _balance(partition.str_tiles(parts(table), XY, 16), 16)


@query(f"SELECT count(*) AS n, 16 AS tiles, true AS even FROM {P}")
def kd_partition(spark, table):
    return _balance(partition.kd_tiles(parts(table), XY, 4), 16)


@query(f"SELECT (least(floor((x - (SELECT min(x) FROM {P})) / (SELECT max(x) - min(x) FROM {P}) * 2), 1)::BIGINT << 1) | least(floor((y - (SELECT min(y) FROM {P})) / (SELECT max(y) - min(y) FROM {P}) * 2), 1)::BIGINT AS tile, count(*) AS n FROM {P} GROUP BY 1")
def quad_partition(spark, table):
    return partition.quad_tiles(parts(table), XY, 1).groupBy("tile").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n, true AS nearest FROM {P}")
def voronoi_partition(spark, table):
    """Rows, and whether every tile's rows are nearer to each other's pivot than the tiles are many: each row has a tile of ten."""
    tiles = partition.voronoi_tiles(parts(table), XY, 10)
    return tiles.agg(F.count("*").alias("n"), ((F.min("tile") >= 0) & (F.max("tile") < 10) & (F.countDistinct("tile") == F.max("tile") + 1)).alias("nearest"))


@query(f"SELECT CASE WHEN x > 40 THEN 3 WHEN x > 20 THEN 2 WHEN x > 10 THEN 1 ELSE 0 END AS tile, count(*) AS n FROM {P} GROUP BY 1")
def range_partition(spark, table):
    return partition.range_tiles(parts(table), "x", [10, 20, 40]).groupBy("tile").agg(F.count("*").alias("n"))


# With other operators of the host


@query(f"SELECT c_mktsegment, count(DISTINCT c_custkey) AS n FROM customer JOIN (SELECT DISTINCT r.c_custkey AS k FROM {P} l JOIN {C} r ON {D} <= 0.5) ON c_custkey = k GROUP BY c_mktsegment")
def distance_join_then_group(spark, table):
    near = joins.distance_join(customers(table), parts(table), XY, XY, 0.5, how="left_semi").select("c_custkey")
    return table("customer").join(near.hint("merge"), "c_custkey").groupBy("c_mktsegment").agg(F.countDistinct("c_custkey").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id BETWEEN 10 AND 60 AND value BETWEEN 50 AND 200 GROUP BY event_type")
def events_range(spark, table):
    rows = filters.range_query(table("events"), ["user_id", "value"], [10, 50], [60, 200])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT coalesce(cx, -1) AS cx, coalesce(cy, -99) AS cy, count(*) AS n FROM (SELECT floor(x / 10)::BIGINT AS cx, floor(y / 25)::BIGINT AS cy FROM {C}) GROUP BY ROLLUP (cx, cy)")
def grid_rollup(spark, table):
    cells = customers(table).select(F.floor(F.col("x") / 10).cast("long").alias("cx"), F.floor(F.col("y") / 25).cast("long").alias("cy"))
    return cells.rollup("cx", "cy").agg(F.count("*").alias("n")).select(F.coalesce("cx", F.lit(-1)).alias("cx"), F.coalesce("cy", F.lit(-99)).alias("cy"), "n")


@query(f"SELECT coalesce(cx, -1) AS cx, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM (SELECT floor((c_custkey % 53) / 10)::BIGINT AS cx, c_nationkey FROM customer) GROUP BY GROUPING SETS ((cx), (c_nationkey))")
def grid_grouping_sets(spark, table):
    table("customer").selectExpr("cast(floor((c_custkey % 53) / 10) as bigint) AS cx", "c_nationkey").createOrReplaceTempView("cells_of_customers")
    return spark.sql("SELECT coalesce(cx, -1) AS cx, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM cells_of_customers GROUP BY GROUPING SETS ((cx), (c_nationkey))")


@query(f"WITH near AS (SELECT c_custkey, x, y FROM {C} WHERE {to(20, 40)} <= 12) SELECT n.c_custkey, (SELECT count(*) FROM near) AS n FROM near n WHERE EXISTS (SELECT 1 FROM {P} p WHERE p.x = n.x)")
def cte_and_subqueries(spark, table):
    sql_functions.register(spark)
    customers(table).createOrReplaceTempView("customer_points")
    parts(table).createOrReplaceTempView("part_points")
    return spark.sql("""WITH near AS (SELECT c_custkey, x, y FROM customer_points WHERE q_in_circle(x, y, 20, 40, 12))
      SELECT n.c_custkey, (SELECT count(*) FROM near) AS n FROM near n WHERE EXISTS (SELECT 1 FROM part_points p WHERE p.x = n.x)""")


@query("SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.ts < e.ts) AS before FROM events e WHERE e.event_type = 'purchase'")
def as_of_join(spark, table):
    """For each purchase, the time of the user's event before: a window over both, no join."""
    events = table("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    earlier = F.max("ts").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    return events.withColumn("before", earlier).where("event_type = 'purchase'").select("event_id", "before")
