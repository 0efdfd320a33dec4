"""Filters and joins against brute force on lattices with ties, repeats, nulls and NaN."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.operators import filters, joins
from quadrille.plans.config import Config

SIX = [(float(k), float(k), 3.0, str(n)) for n, k in enumerate((1, 2, 2, 2, 3, 4), 1)]


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame(SIX, "x double, y double, z double, other string").cache()


def others(df):
    return sorted(r["other"] for r in df.collect())


def test_filters(six):
    assert others(filters.range_query(six, ["x", "y"], [1, 1], [3, 3])) == ["1", "2", "3", "4", "5"]
    assert others(filters.range_query(six, ["x"], [1], [2])) == ["1", "2", "3", "4"]
    assert others(filters.range_query(six, g.Point.of("x", "y"), [3, 3], [9, 9])) == ["5", "6"]
    assert others(filters.circle_range(six, ["x", "y"], [1, 1], math.sqrt(2))) == ["1", "2", "3", "4"]
    assert others(filters.circle_range(six, ["x", "y"], [1, 1], -1)) == []
    assert others(filters.circles(six, ["x", "y"], [([1, 1], 1.5), ([3, 3], 1.5)])) == ["2", "3", "4"]
    assert others(filters.knn(six, ["x", "y"], [1, 1], 4, ["other"])) == ["1", "2", "3", "4"]
    assert others(filters.knn(six, ["x", "y"], [1, 1], 2, keep_ties=True)) == ["1", "2", "3", "4"]
    assert others(filters.knn(six, ["x", "y"], [1, 1], 0)) == []
    with pytest.raises(ValueError):
        filters.range_query(six, ["nope"], [1], [2])
    with pytest.raises(ValueError):
        filters.range_query(six, ["x"], [2], [1])


def test_boolean_combinations(six):
    near = filters.knn(six, ["x", "y"], [1, 1], 4, ["other"])
    box = filters.range_query(six, ["x", "y"], [2, 2], [4, 4])
    assert others(filters.both(near, box)) == ["2", "3", "4"]
    assert others(filters.either(near, box)) == ["1", "2", "3", "4", "5", "6"]
    assert others(filters.without(six, near)) == ["5", "6"]
    # A later filter applies to the neighbours, not before them.
    assert others(near.where("x > 2")) == []


def test_diamond(spark):
    points = [(float(i), float(j)) for i in range(-10, 11) for j in range(-10, 11) if abs(i) + abs(j) <= 10]
    df = spark.createDataFrame(points, "x double, y double").cache()
    assert len(points) == 221
    assert filters.range_query(df, ["x", "y"], [0, 0], [9, 9]).count() == sum(0 <= x <= 9 and 0 <= y <= 9 for x, y in points)
    assert filters.circle_range(df, ["x", "y"], [6, 6], 6).count() == sum(math.hypot(x - 6, y - 6) <= 6 for x, y in points)
    balls = [([6, 6], 10), ([-3, 0], 3), ([0, -5], 7)]
    assert filters.circles(df, ["x", "y"], balls).count() == sum(all(math.hypot(x - c[0], y - c[1]) <= r for c, r in balls) for x, y in points)
    assert {tuple(r) for r in filters.knn(df, ["x", "y"], [10, 9], 4).collect()} == {(7, 3), (6, 4), (5, 5), (4, 6)}


def test_key_ranks(spark):
    df = spark.createDataFrame([(i % 11,) for i in range(101)], "key int")
    rows = {r["key"]: (r["n"], r["rank"]) for r in filters.ranks(df, "key").collect()}
    upto = 0
    for k in range(11):
        n = 10 if k in (0, 1) else 9
        upto += n
        assert rows[k] == (n, upto)
    assert filters.rank_of(df, "key", 3).first()[0] == 38
    assert filters.count_of(df, "key", 0) == 10 and filters.count_of(df, "key", 99) == -1
    assert 0.2 < filters.estimate_selectivity(df, ["key"], [3], [5], 1.0) < 0.3


def lattice(seed, n, dims, size=6):
    r = random.Random(seed)
    rows = [(k % (n - 3), *(float(r.randint(0, size)) / (2 if r.random() < 0.3 else 1) for _ in range(dims))) for k in range(n)]
    return rows + [(1000, *([None] + [1.0] * (dims - 1))), (1001, *([float("nan")] + [1.0] * (dims - 1)))]


def frame(spark, rows, dims):
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"k{d} double" for d in range(dims)))


def dist(a, b):
    total = 0.0
    for x, y in zip(a[1:], b[1:], strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def good(row):
    return all(x is not None and x == x for x in row)


@pytest.mark.parametrize(("dims", "r"), [(1, 1.0), (2, 1.0), (2, 0.0), (2, -1.0), (3, 1.5)])
def test_distance_join_strategies(spark, dims, r):
    left, right = lattice(1, 60, dims), lattice(2, 50, dims)
    expected = sorted((a[0], b[0], dist(a, b)) for a in left for b in right if good(a) and good(b) and dist(a, b) <= r)
    keys = [f"k{d}" for d in range(dims)]
    for strategy, salt in (("grid", 1), ("grid", 3), ("nested_loop", 1), ("block", 1), ("broadcast", 1)):
        got = joins.distance_join(frame(spark, left, dims), frame(spark, right, dims), keys, keys, r, strategy, dist_col="d", salt=salt)
        assert got.columns == ["id_l", *[f"{k}_l" for k in keys], "id_r", *[f"{k}_r" for k in keys], "d"]
        assert sorted((x["id_l"], x["id_r"], x["d"]) for x in got.collect()) == expected


def test_distance_join_on_cell_edges(spark):
    r = 0.1
    xs = [k * r for k in range(-20, 20)]
    xs += [math.nextafter(x, 9) for x in xs] + [math.nextafter(x, -9) for x in xs]
    rows = [(k, x) for k, x in enumerate(xs)]
    expected = sum(abs(a - b) <= r for a in xs for b in xs)
    df = frame(spark, rows, 1)
    assert joins.distance_join(df, df, ["k0"], ["k0"], r, "grid").count() == expected


@pytest.mark.parametrize(("dims", "k"), [(1, 2), (2, 3), (2, 1), (3, 4), (4, 2), (2, 500), (2, 0)])
def test_knn_join_strategies(spark, dims, k):
    left = lattice(3, 40, dims) + [(2000, *[50.0] * dims), (2001, *[-7.0] * dims)]
    right = lattice(4, 60, dims)
    expected = []
    for a in left:
        if good(a):
            near = sorted((dist(a, b), b[0]) for b in right if good(b))[:k]
            expected += [(a[0], b, d) for d, b in near]
    keys = [f"k{d}" for d in range(dims)]
    for strategy in ("grid", "broadcast", "nested_loop", "voronoi"):
        got = joins.knn_join(frame(spark, left, dims), frame(spark, right, dims), keys, keys, k, ["id"], strategy, dist_col="d")
        assert sorted((x["id_l"], x["id_r"], x["d"]) for x in got.collect()) == sorted(expected), strategy


def test_joins_with_empty_sides(spark):
    some, none = frame(spark, lattice(5, 10, 2), 2), frame(spark, lattice(5, 10, 2), 2).limit(0)
    keys = ["k0", "k1"]
    for a, b in ((some, none), (none, some)):
        assert joins.distance_join(a, b, keys, keys, 1.0).count() == 0
        for strategy in ("grid", "broadcast", "nested_loop", "voronoi", "zorder"):
            assert joins.knn_join(a, b, keys, keys, 2, strategy=strategy).count() == 0


@pytest.mark.parametrize("seed", [6, 7])
@pytest.mark.parametrize("n", [400, 3000])
def test_z_order_recall(spark, seed, n):
    r = np.random.default_rng(seed)
    a, b = r.uniform(-5, 5, (200, 2)), np.concatenate([r.uniform(-5, 5, (n // 2, 2)), r.normal(1, 0.1, (n // 2, 2))])
    left, right = ([(k, *map(float, x)) for k, x in enumerate(rows)] for rows in (a, b))
    near = np.argsort(((a[:, None] - b[None]) ** 2).sum(axis=2), axis=1)[:, :5]
    exact = {(k, int(x)) for k, row in enumerate(near) for x in row}
    got = {(x["id_l"], x["id_r"]) for x in joins.zknn_join(frame(spark, left, 2), frame(spark, right, 2), ["k0", "k1"], ["k0", "k1"], 5, ["id"]).collect()}
    assert len(got) == 1000
    assert len(got & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("strategy", ["broadcast", "grid", "auto"])
def test_knn_join_over_many_right_rows(spark, strategy):
    """300,000 right rows, a third of them in one small place."""
    r = np.random.default_rng(8)
    b = np.concatenate([r.uniform(0, 100, (200_000, 2)), r.normal(20, 0.01, (100_000, 2))])
    a = np.concatenate([r.uniform(-10, 110, (60, 2)), r.normal(20, 0.01, (20, 2))])
    tables = [spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "k0": x[:, 0], "k1": x[:, 1]})) for x in (a, b)]
    got = joins.knn_join(*tables, ["k0", "k1"], ["k0", "k1"], 4, ["id"], strategy).select("id_l", "id_r").collect()
    d = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))
    assert {tuple(x) for x in got} == {(k, int(x)) for k, row in enumerate(np.argsort(d, axis=1)[:, :4]) for x in row}


def test_cells_find_what_all_points_do():
    r = np.random.default_rng(9)
    for dims, n, k in ((1, 500, 3), (2, 2000, 5), (3, 700, 4), (2, 4, 9), (2, 300, 300)):
        points = np.round(r.normal(0, 3, (n, dims)), 1)  # many ties
        places = np.concatenate([np.round(r.normal(0, 4, (100, dims)), 1), np.full((1, dims), 1e6)])
        near, away = joins.CellIndex(points, k).nearest(places)
        d = np.sqrt(sum((places[:, None, i] - points[None, :, i]) ** 2 for i in range(dims)))
        want = np.argsort(d, axis=1, kind="stable")[:, : min(k, n)]
        assert (near == want).all()
        assert (away == np.take_along_axis(d, want, axis=1)).all()


def test_too_large_sides_are_not_broadcast(spark):
    df, config = frame(spark, lattice(5, 30, 2), 2), Config(spark)
    config.set("join.broadcastRows", 5)
    try:
        for join in (lambda: joins.knn_join(df, df, ["k0"], ["k0"], 1, strategy="broadcast"), lambda: joins.distance_join(df, df, ["k0"], ["k0"], 1.0, "broadcast")):
            with pytest.raises(ValueError, match="too many to broadcast"):
                join()
        assert joins.knn_join(df, df, ["k0"], ["k0"], 1, ["id"]).count() == 30 + 1
    finally:
        config.unset("join.broadcastRows")


ODD_NAMES = ["__c0", "__o", "__salt", "__id", "l", "r", "p", "q", "d", "t", "id", "rid", "place", "level", "a.b", "c`d"]


def test_joins_keep_columns_of_any_name(spark):
    left, right = (spark.createDataFrame([(float(k % 5), *range(k, k + len(ODD_NAMES))) for k in range(n)], ", ".join(["x double", *[f"`{c.replace('`', '``')}` long" for c in ODD_NAMES]])) for n in (20, 12))
    for pairs in (
        *[joins.distance_join(left, right, ["x"], ["x"], 1.0, s, salt=2) for s in ("grid", "block", "broadcast")],
        *[joins.knn_join(left, right, ["x"], ["x"], 2, ["__id"], s) for s in ("grid", "broadcast", "voronoi", "block", "zorder")],
        joins.shape_join(left, right, lambda c: g.Box.of([c("x"), c("x")], [c("x") + 1, c("x") + 1]), lambda c: g.Point.of(c("x"), c("x"))),
    ):
        assert pairs.columns == [f"{c}{s}" for s in ("_l", "_r") for c in ["x", *ODD_NAMES]]
        rows = pairs.collect()
        assert rows
        for row in rows:
            for s in ("_l", "_r"):
                first = row[f"{ODD_NAMES[0]}{s}"]
                assert [row[f"{c}{s}"] for c in ODD_NAMES] == list(range(first, first + len(ODD_NAMES)))


def test_shape_join(spark):
    """Boxes of sizes that differ by four powers of ten, and circles."""
    r = random.Random(10)
    boxes = [(k, x := r.uniform(-50, 50), y := r.uniform(-50, 50), x + 10 ** r.uniform(-2, 2), y + 10 ** r.uniform(-2, 2)) for k in range(120)] + [(500, None, 1.0, 2.0, 2.0), (501, 0.0, 0.0, 0.0, 0.0), (502, -1e4, -1e4, 1e4, 1e4)]
    a = spark.createDataFrame(boxes, "id long, lx double, ly double, hx double, hy double")
    box = lambda c: g.Box.of([c("lx"), c("ly")], [c("hx"), c("hy")])
    known = [b for b in boxes if None not in b]
    meet = lambda p, q, r=0: math.hypot(max(q[1] - p[3], p[1] - q[3], 0), max(q[2] - p[4], p[2] - q[4], 0)) <= r
    for reach in (0, 3.0):
        got = sorted((x["id_l"], x["id_r"]) for x in joins.shape_join(a, a, box, box, reach).collect())
        assert got == sorted((p[0], q[0]) for p in known for q in known if meet(p, q, reach))
    circle = lambda c: g.Circle.of([c("lx"), c("ly")], c("hx") - c("lx"))
    got = sorted((x["id_l"], x["id_r"]) for x in joins.shape_join(a, a, box, circle, dist_col="far").collect())
    apart = lambda p, q: math.hypot(max(p[1] - q[1], q[1] - p[3], 0), max(p[2] - q[2], q[2] - p[4], 0))
    assert got == sorted((p[0], q[0]) for p in known for q in known if apart(p, q) <= q[3] - q[1])
    assert joins.shape_join(a.limit(0), a, box, box).count() == 0


def test_join_errors(spark):
    df = frame(spark, lattice(5, 10, 2), 2)
    with pytest.raises(ValueError):
        joins.distance_join(df, df, ["nope"], ["k0"], 1)
    with pytest.raises(ValueError):
        joins.knn_join(df, df, ["k0"], ["k0", "k1"], 1)
    with pytest.raises(ValueError):
        joins.knn_join(df, df, ["k0"], ["k0"], 1, strategy="magic")


def test_joins_on_a_column_of_points(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, None]), (3, None), (4, [9.0, 9.0])], "a long, at array<double>")
    right = spark.createDataFrame([(1, [0.0, 1.0]), (2, [9.0, 8.5]), (3, [float("nan"), 0.0])], "b long, at array<double>")
    pairs = joins.distance_join(left, right, ("at", 2), ("at", 2), 1.0)
    assert sorted((r["a"], r["b"], r["at_l"]) for r in pairs.collect()) == [(1, 1, [0.0, 0.0]), (4, 2, [9.0, 9.0])]
    near = joins.knn_join(left, right, ("at", 2), ("at", 2), 1, ["b"])
    assert sorted((r["a"], r["b"]) for r in near.collect()) == [(1, 1), (4, 2)]
    with pytest.raises(ValueError):
        joins.distance_join(left, right, ("no", 2), ("at", 2), 1.0)


def test_wide_right_rows_are_not_broadcast(spark):
    left = spark.createDataFrame([(k, float(k % 7), float(k % 5)) for k in range(30)], "a long, x double, y double")
    right = spark.createDataFrame([(k, float(k % 11), float(k % 3), "w" * 50) for k in range(40)], "b long, x double, y double, load string")
    config = Config(spark)
    want = sorted((r["a"], r["b"]) for r in joins.knn_join(left, right, ["x", "y"], ["x", "y"], 3, ["b"]).collect())
    config.set("join.broadcastBytes", 1000)
    try:
        near = joins.knn_join(left, right, ["x", "y"], ["x", "y"], 3, ["b"])
        assert "MapInArrow" not in near._jdf.queryExecution().toString()
        assert sorted((r["a"], r["b"]) for r in near.collect()) == want
    finally:
        config.unset("join.broadcastBytes")


@pytest.mark.parametrize("r", [0.0, 1.0, -1.0])
def test_distance_join_kinds(spark, r):
    """Left rows with or without a pair, those of unknown keys among them; the repeated side isn't broadcast by its files' size."""
    left, right = lattice(11, 60, 2), lattice(12, 20, 2)
    pairs = [(a[0], b[0]) for a in left for b in right if good(a) and good(b) and dist(a, b) <= r]
    alone = [a[0] for a in left if not any(good(a) and good(b) and dist(a, b) <= r for b in right)]
    matched = [a[0] for a in left if any(good(a) and good(b) and dist(a, b) <= r for b in right)]
    for strategy, salt in (("grid", 1), ("grid", 3), ("broadcast", 1)):
        kinds = {how: joins.distance_join(frame(spark, left, 2), frame(spark, right, 2), ["k0", "k1"], ["k0", "k1"], r, strategy, salt=salt, how=how) for how in ("inner", "left", "left_semi", "left_anti")}
        assert sorted((x["id_l"], x["id_r"]) for x in kinds["inner"].collect()) == sorted(pairs)
        assert Counter((x["id_l"], x["id_r"]) for x in kinds["left"].collect()) == Counter(pairs + [(a, None) for a in alone])
        assert kinds["left_semi"].columns == kinds["left_anti"].columns == ["id", "k0", "k1"]
        assert sorted(x["id"] for x in kinds["left_semi"].collect()) == sorted(matched)
        assert sorted(x["id"] for x in kinds["left_anti"].collect()) == sorted(alone)
        if strategy == "grid" and r >= 0:
            assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in kinds.values())
    with pytest.raises(ValueError):
        joins.distance_join(frame(spark, left, 2), frame(spark, right, 2), ["k0"], ["k0"], r, "block", how="left")


def test_places_outside_the_points_are_found_by_few_candidates(monkeypatch):
    """Half of the places are outside the points, as of a filtered side: cells around them are looked at within the distance only."""
    r = np.random.default_rng(13)
    points = np.stack([r.integers(0, 53, 20_000).astype(float), r.uniform(50, 100, 20_000)], axis=1)
    places = np.stack([r.integers(0, 53, 300).astype(float), r.uniform(0, 40, 300)], axis=1)
    index, looked = joins.CellIndex(points, 2), []
    best = joins.CellIndex._best
    monkeypatch.setattr(joins.CellIndex, "_best", lambda self, places, rows, owner, begins, counts, *out: (looked.append(int(counts.sum())), best(self, places, rows, owner, begins, counts, *out)))
    near, away = index.nearest(places)
    d = np.sqrt(((places[:, None] - points[None]) ** 2).sum(axis=2))
    assert (near == np.argsort(d, axis=1, kind="stable")[:, :2]).all()
    assert sum(looked) < 300 * 2_000


def test_a_worker_compares_few_candidates_at_a_time():
    """20,000 places, and a place with 50,000 points: memory is bounded by the candidates of a pass."""
    r = np.random.default_rng(14)
    points = np.concatenate([np.zeros((50_000, 2)), r.uniform(0, 10, (50_000, 2))])
    tracemalloc.start()
    near, _ = joins.CellIndex(points, 3).nearest(r.uniform(0, 10, (20_000, 2)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.shape == (20_000, 3)
    assert peak < 100e6


@pytest.mark.parametrize("strategy", ["block", "voronoi", "grid", "zorder"])
def test_knn_join_of_repeated_places(spark, strategy):
    """3,000 left rows in 200 places and 3,000 right rows in 600; nothing is broadcast by its files' size."""
    r = np.random.default_rng(15)
    a, b = r.integers(0, 200, 3000), r.integers(0, 600, 3000)
    at, to = np.round(r.uniform(0, 30, (200, 2)), 1), np.round(r.uniform(0, 20, (600, 2)), 1)
    left, right = (spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "k0": x[:, 0], "k1": x[:, 1]})) for x in (at[a], to[b]))
    pairs = joins.knn_join(left, right, ["k0", "k1"], ["k0", "k1"], 3, ["id"], strategy)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan or strategy in ("voronoi", "zorder")  # theirs are a table of pivots and one of offsets
    got = {}
    for x in pairs.select("id_l", "id_r").collect():
        got.setdefault(x["id_l"], set()).add(x["id_r"])
    d = np.sqrt(((at[:, None] - to[b][None]) ** 2).sum(axis=2))
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    same = sum(len(got[k] & {int(x) for x in want[a[k]]}) for k in range(3000))
    assert all(len(x) == 3 for x in got.values()) and len(got) == 3000
    assert strategy == "zorder" or same == 9000
    assert all(got[k] == got[int(np.flatnonzero(a == a[k])[0])] for k in range(3000))  # left rows in one place have the same neighbours


@pytest.mark.parametrize("strategy", ["nested_loop", "block"])
def test_blocks_far_apart_are_not_compared(spark, strategy, monkeypatch):
    monkeypatch.setattr(joins, "_PAIRS", 1000)
    monkeypatch.setattr(joins, "_BLOCK_BITS", 6)
    r = np.random.default_rng(16)
    a, b = np.round(r.uniform(0, 100, (6000, 2)), 1), np.round(r.uniform(0, 100, (5000, 2)), 1)
    left, right = (spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "k0": x[:, 0], "k1": x[:, 1]})) for x in (a, b))
    seen, near_blocks = [], joins._near_blocks
    monkeypatch.setattr(joins, "_near_blocks", lambda *x, **y: (seen.append(near_blocks(*x, **y)), seen[-1])[1])
    got = joins.distance_join(left, right, ["k0", "k1"], ["k0", "k1"], 1.0, strategy).select("id_l", "id_r").collect()
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert {tuple(x) for x in got} == {(int(i), int(j)) for i, j in np.argwhere(d <= 1.0)} and len(got) == int((d <= 1.0).sum())
    blocks = seen[0].agg(*[F.countDistinct(c) for c in ("lb", "rb")]).first()
    assert seen[0].count() < blocks[0] * blocks[1] / 2


def test_shapes_in_hot_cells(spark, monkeypatch):
    """Cells of more rows than a key may have are dealt out; flat boxes don't share cells as wide as they are."""
    r = np.random.default_rng(17)
    rows = [(k, x, y, x + 3.0, y + 0.01) for k, (x, y) in enumerate((float(x), float(y)) for x, y in zip(r.integers(0, 20, 400), r.uniform(0, 3, 400)))]
    a = spark.createDataFrame(rows, "id long, lx double, ly double, hx double, hy double")
    box = lambda c: g.Box.of([c("lx"), c("ly")], [c("hx"), c("hy")])
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    dealt, keys = joins._dealt, []
    monkeypatch.setattr(joins, "_dealt", lambda left, right, same: (keys.append(left.groupBy("lw", "lc0", "lc1").count().count()), dealt(left, right, same))[1])
    assert sorted((x["id_l"], x["id_r"]) for x in joins.shape_join(a, a, box, box).collect()) == want
    assert keys[0] > 400  # two or three cells at a time hold each box, and the boxes are at 20 x 300 places
    monkeypatch.setattr(joins, "_KEY_ROWS", 2)
    pairs = joins.shape_join(a, a, box, box)
    assert sorted((x["id_l"], x["id_r"]) for x in pairs.collect()) == want
    assert "li#" in pairs._jdf.queryExecution().optimizedPlan().toString()
