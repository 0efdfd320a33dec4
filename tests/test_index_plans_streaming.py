"""Indexes, partitioners, predicates, settings, SQL functions and streams."""

import math
import random

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from quadrille.functions import sql as sql_functions
from quadrille.operators import filters, partition
from quadrille.operators.joins import knn_join
from quadrille.plans.config import Config
from quadrille.plans.predicates import And, InBox, InCircle, InKnn, Interval, Leaf, Not, Or, intervals, leaf_interval, partitions_for, to_cnf, to_dnf
from quadrille.sources.index import Registry
from quadrille.streaming import spatial


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(1)
    rows = [(k, float(r.randint(0, 40)), float(r.randint(0, 40))) for k in range(600)] + [(600, None, 1.0), (601, float("nan"), 1.0), (602, 3.0, 3.0), (602, 3.0, 3.0)]
    return spark.createDataFrame(rows, "id long, x double, y double").cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("kind", ["rtree", "quadtree"])
def test_tiled_indexes(spark, points, kind, tmp_path):
    registry = Registry(spark)
    index = registry.create(points, kind, "place", ["x", "y"], 16)
    box = ids(points.where("x between 3 and 9 and y between 2 and 12 and not isnan(x)"))
    ball = ids(points.where("sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5)) <= 6 and not isnan(x)"))
    for i in (index,):
        assert ids(i.range([3, 2], [9, 12])) == box and ids(i.circle([5, 5], 6)) == ball
    assert ids(index.rows()) == ids(points)  # nothing is lost, repeats and nulls included
    assert len(index.knn([5, 5], 7, ["id"]).collect()) == 7
    registry.persist(index.table, "place", str(tmp_path / "index"))
    again = Registry(spark).load(str(tmp_path / "index"), "loaded")
    assert ids(again.range([3, 2], [9, 12])) == box and ids(again.circle([5, 5], 6)) == ball
    assert sorted(again.rows().columns) == sorted(points.columns)


@pytest.mark.parametrize("kind", ["rtree", "quadtree"])
def test_index_neighbours_come_from_few_tiles(spark, points, kind):
    index = Registry(spark).create(points, kind, "near", ["x", "y"], 16)
    for target, k in (([5, 5], 7), ([-30, 90], 1), ([20, 20], 40), ([5, 5], 10_000), ([0, 0], 0)):
        for ties in (False, True):
            found = index.knn(target, k, ["id"], ties)
            assert ids(found) == ids(filters.knn(points, ["x", "y"], target, k, ["id"], ties))
    plan = index.knn([5, 5], 7, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__tile" in plan.split("Filter")[1]
    assert sum(n for *_, n in index.extents) == 602


@pytest.mark.parametrize("kind", ["treap", "treemap", "hashmap"])
def test_key_indexes_keep_repeated_keys(spark, points, kind):
    index = Registry(spark).create(points, kind, "key", ["x"], 4)
    assert ids(index.equals(3.0)) == ids(points.where("x = 3"))
    assert ids(index.range([3], [4])) == ids(points.where("x between 3 and 4"))
    assert ids(index.range([100], [200])) == []


def test_registry(spark, points):
    points.createOrReplaceTempView("places")
    registry = Registry(spark)
    registry.create("places", "rtree", "a", ["x", "y"], 4)
    registry.create("places", "hashmap", "b", ["id"], 4)
    other = registry.create(points.where("x > 1"), "treap", "a", ["x"], 4)
    assert registry.has("places", "a") and not registry.has("places", "c")
    assert {tuple(r)[:4] for r in registry.show("places").collect()} == {("places", "a", "x,y", "rtree"), ("places", "b", "id", "hashmap")}
    assert registry.find(points.where("x > 1"), "a") is other and registry.find(points.where("x > 2")) is None
    registry.set_level("places", "a", StorageLevel.DISK_ONLY)
    assert registry.get("places", "a").level == StorageLevel.DISK_ONLY
    for bad in (lambda: registry.create("places", "rtree", "a", ["x"]), lambda: registry.create("places", "btree", "z", ["x"]), lambda: registry.create("places", "rtree", "z", ["no"]), lambda: registry.create("places", "treap", "z", ["x", "y"])):
        with pytest.raises(ValueError):
            bad()
    registry.drop("places", "a")
    assert registry.has("places", "b")  # only the named one goes
    registry.drop_by_column("places", "id")
    assert not registry.has("places", "b") and registry.has(other.table, "a")
    registry.clear()
    assert registry.show().count() == 0


def test_tiles(spark, points):
    for tiled in (partition.str_tiles(points, ["x", "y"], 9), partition.kd_tiles(points, ["x", "y"], 3), partition.quad_tiles(points, ["x", "y"], 2), partition.voronoi_tiles(points, ["x", "y"], 5), partition.range_tiles(points, "x", [10, 20])):
        counts = {r["tile"]: r["count"] for r in tiled.groupBy("tile").count().collect()}
        assert counts.pop(-1) == 2 and sum(counts.values()) == points.count() - 2
        assert len(counts) > 2 and max(counts.values()) < 400
    few = partition.str_tiles(points.limit(0), ["x", "y"], 9)
    assert few.count() == 0 and partition.voronoi_tiles(points.limit(0), ["x"], 3).count() == 0
    assert partition.by_id(points.where("id < 99"), "id", 3).rdd.getNumPartitions() == 3


def test_intervals():
    assert Interval(0, 0, True, False).empty() and not Interval(0, 0).empty()
    own = Interval(-1, 1)
    assert own.intersect(Interval(0, 2, True, True)) == Interval(0, 1, True, False)
    assert own.intersect(Interval(1, 3, False, True)) == Interval(1, 1)
    assert own.intersect(Interval(1, 3, True, True)).empty()
    assert leaf_interval(Leaf("a", "=", 10)) == Interval(10, 10)
    assert leaf_interval(Leaf("a", "<", 10)) == Interval(high=10, high_open=True)
    found, rest = intervals([Leaf("zero", "<", 10), Leaf("ten", ">", 0), "other"], ["ten", "zero"])
    assert found == [Interval(low=0, low_open=True), Interval(high=10, high_open=True)] and rest == ["other"]
    assert intervals([Leaf("a", ">", 10), Leaf("a", "<", 5)], ["a"])[0][0].empty()
    assert partitions_for(Interval(2.5, 4.5), [1, 2, 3, 4, 5]) == [2, 3, 4]
    assert partitions_for(Interval(5.5, 6.5), [1, 2, 3, 4, 5]) == [5]
    assert partitions_for(Interval(3, 1), [1, 2]) == []


def test_normal_forms():
    a, b, c = (Leaf(x, "<", 1) for x in "abc")
    p = And(a, Or(b, Not(c)))
    assert to_dnf(p) == [[a, b], [a, Leaf("c", ">=", 1)]]
    assert to_cnf(Not(Or(a, b))) == [[Leaf("a", ">=", 1)], [Leaf("b", ">=", 1)]]
    r = random.Random(2)

    def value(p, at):
        if isinstance(p, Leaf):
            return leaf_interval(p).holds(at[p.column])
        if isinstance(p, Not):
            return not value(p.a, at)
        return (value(p.a, at) and value(p.b, at)) if isinstance(p, And) else (value(p.a, at) or value(p.b, at))

    def build(depth):
        if not depth or r.random() < 0.2:
            return Leaf(r.choice("abc"), r.choice(["=", "<", "<=", ">", ">="]), r.randint(0, 2))
        return r.choice([lambda: And(build(depth - 1), build(depth - 1)), lambda: Or(build(depth - 1), build(depth - 1)), lambda: Not(build(depth - 1))])()

    for _ in range(60):
        p, at = build(3), {x: r.randint(0, 2) for x in "abc"}
        assert any(all(value(q, at) for q in part) for part in to_dnf(p)) == value(p, at)
        assert all(any(value(q, at) for q in part) for part in to_cnf(p)) == value(p, at)


def test_config(spark):
    config = Config(spark)
    assert config.get("join.knn") == "auto" and config.get("index.partitions") == 200
    config.set("index.partitions", 7)
    assert config.get("index.partitions") == 7 and config.all()["index.partitions"] == 7
    config.unset("index.partitions")
    assert config.get("index.partitions") == 200 and config.get("index.partitions", 5) == 5
    for key, value in (("join.knn", "magic"), ("index.partitions", 0), ("sample.rate", 2)):
        with pytest.raises(ValueError):
            config.set(key, value)
    with pytest.raises(KeyError):
        config.get("nope")


@pytest.mark.parametrize("method", ["kd", "quad", "voronoi"])
def test_settings_choose_but_do_not_change_results(spark, points, method):
    config = Config(spark)
    chosen = {"partition.method": method, "index.partitions": 8, "index.selectivity": "true", "index.selectivityThreshold": 0.0, "join.knn": "nested_loop", "join.distance": "nested_loop", "zorder.shifts": 1}
    near = knn_join(points, points, ["x", "y"], ["x", "y"], 2, ["id"], dist_col="d").select("id_l", "d")
    for key, value in chosen.items():
        config.set(key, value)
    index = Registry(spark).create(points, "rtree", "place", ["x", "y"])
    assert ids(index.range([3, 2], [9, 12])) == ids(points.where("x between 3 and 9 and y between 2 and 12 and not isnan(x)"))
    other = knn_join(points, points, ["x", "y"], ["x", "y"], 2, ["id"], dist_col="d").select("id_l", "d")
    assert near.exceptAll(other).isEmpty()
    for key in chosen:
        config.unset(key)


def test_sql_functions(spark, points):
    assert "q_dist" in sql_functions.register(spark)
    points.createOrReplaceTempView("places")
    assert spark.sql("SELECT q_dist(0, 0, 3, 4), q_box_dist(5, 5, 0, 0, 2, 1), q_in_circle(1, 1, 0, 0, 1)").first()[:] == (5.0, 5.0, False)
    assert spark.sql("SELECT count(*) FROM (SELECT q_cell(x, 10) AS cx, q_cell(y, 10) AS cy FROM places WHERE id = 5) p, LATERAL q_cells_around(p.cx, p.cy)").first()[0] == 9


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(source)
    (tmp_path / "in").mkdir()
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    keys = ["user_id", "value"]
    batch = spatial.circle_range(spatial.range_query(events, keys, [0, 0], [60, 300]), keys, [30, 100], 80)
    assert run(spatial.circle_range(spatial.range_query(stream, keys, [0, 0], [60, 300]), keys, [30, 100], 80), "ball").count() == batch.count() > 0
    static = spark.createDataFrame([(float(k), 50.0 * k) for k in range(10)], "sx double, sy double")
    pairs = spatial.distance_join_static(stream, static, keys, ["sx", "sy"], 15.0)
    assert run(pairs, "pairs").count() == spatial.distance_join_static(events, static, keys, ["sx", "sy"], 15.0).count() > 0
    counts = run(spatial.windowed_counts(stream, "ts", ["value"], 100.0, "1 hour", "365 days"), "counts")
    assert counts.columns == ["window", "cell_value", "n"]
    assert "session_window" in spatial.sessions(stream, "ts", "user_id", "10 minutes", "1 hour").columns
    last = {}
    spatial.running_knn(stream, keys, [30, 100], 5, str(tmp_path / "near"), str(tmp_path / "near_log"), ["event_id"], lambda rows, n: last.update(ids=sorted(r["event_id"] for r in rows.collect()))).awaitTermination()
    from quadrille.operators.filters import knn

    assert last["ids"] == sorted(r["event_id"] for r in knn(events, keys, [30, 100], 5, ["event_id"]).collect())


def test_deep_kd_tiles(spark):
    """256 tiles of equal counts over 20,000 rows, and fewer where rows share places."""
    r = random.Random(12)
    rows = [(r.random(), r.random()) for _ in range(20_000)]
    counts = [x["count"] for x in partition.kd_tiles(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], 8).groupBy("tile").count().collect()]
    assert len(counts) == 256 and sum(counts) == 20_000 and max(counts) < 1.5 * 20_000 / 256
    same = partition.kd_tiles(spark.createDataFrame([(1.0, 1.0)] * 50 + [(2.0, None)], "x double, y double"), ["x", "y"], 5).groupBy("tile").count().collect()
    assert sorted(x["count"] for x in same) == [1, 50]


def test_normal_forms_are_bounded():
    p = Leaf("a", "=", 0)
    for k in range(20):
        p = And(p, Or(Leaf("a", "<", k), Leaf("b", ">", k)))
    with pytest.raises(ValueError, match="terms"):
        to_dnf(p)
    assert len(to_cnf(p)) == 21


def test_mixed_predicates_on_an_index(spark):
    """Random trees of comparisons, boxes, balls and nearest neighbours against the same on plain rows."""
    r = random.Random(13)
    rows = [(k, r.uniform(0, 10), r.uniform(0, 10), r.randint(0, 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double, n int")
    index = Registry(spark).create(df, "rtree", "mixed", ["x", "y"], 16)
    keys = ("x", "y")
    near = lambda p: {x[0] for x in sorted(rows, key=lambda x: (math.hypot(x[1] - p.target[0], x[2] - p.target[1]), x[0]))[: p.k]}

    def leaf():
        a, b = r.uniform(0, 10), r.uniform(0, 10)
        return r.choice([Leaf(r.choice(["x", "y", "n"]), r.choice(["<", "<=", ">", ">=", "="]), r.choice([a, 3])), InBox(keys, (a, b), (a + 3, b + 4)), InCircle(keys, (a, b), 2.5), InKnn(keys, (a, b), 30, ("id",))])

    def tree(depth):
        if not depth:
            return leaf()
        a, b = tree(depth - 1), tree(depth - 1)
        return r.choice([And(a, b), Or(a, b), And(a, b) if isinstance(b, InKnn) or depth > 1 else And(a, Not(b))])

    def holds(p, row):
        if isinstance(p, And):
            return holds(p.a, row) and holds(p.b, row)
        if isinstance(p, Or):
            return holds(p.a, row) or holds(p.b, row)
        if isinstance(p, Not):
            return not holds(p.a, row)
        if isinstance(p, InKnn):
            return row[0] in near(p)
        _, x, y, n = row
        if isinstance(p, Leaf):
            return leaf_interval(p).holds({"x": x, "y": y, "n": n}[p.column])
        if isinstance(p, InBox):
            return p.low[0] <= x <= p.high[0] and p.low[1] <= y <= p.high[1]
        return math.hypot(x - p.center[0], y - p.center[1]) <= p.radius

    for k in range(12):
        p = tree(k % 3)
        assert sorted(x["id"] for x in index.where(p).collect()) == [row[0] for row in rows if holds(p, row)], p
    box = And(InBox(keys, (1, 1), (2, 2)), InCircle(keys, (1.5, 1.5), 0.5))
    assert "tile" in index.where(box)._jdf.queryExecution().optimizedPlan().toString()
    for center, radius in (([5, 5], 3.0), ([5, 5], 30.0), ([0, 0], 0.0), ([5, 5], -1.0)):
        assert index.circle_count(center, radius) == sum(math.hypot(x - center[0], y - center[1]) <= radius for _, x, y, _ in rows)
    balls = [([5, 5], 3.0), ([6, 5], 3.0)]
    assert index.circles(balls).count() == sum(all(math.hypot(x - c[0], y - c[1]) <= d for c, d in balls) for _, x, y, _ in rows)


def test_queries_find_their_index(spark):
    df = spark.range(200).selectExpr("id", "id % 17 * 1.0 AS x", "id % 13 * 1.0 AS y")
    registry = Registry(spark)
    want = [sorted(x["id"] for x in q.collect()) for q in (registry.range(df, ["x", "y"], [2, 2], [5, 9]), registry.circle(df, ["x", "y"], [4, 4], 2.5), registry.knn(df, ["x", "y"], [4, 4], 9, ["id"]))]
    registry.create(df, "rtree", "found", ["x", "y"], 9)
    again = spark.range(200).selectExpr("id", "id % 17 * 1.0 AS x", "id % 13 * 1.0 AS y")
    found = registry.range(again, ["x", "y"], [2, 2], [5, 9]), registry.circle(again, ["x", "y"], [4, 4], 2.5), registry.knn(again, ["x", "y"], [4, 4], 9, ["id"])
    assert [sorted(x["id"] for x in q.collect()) for q in found] == want
    assert all("InMemoryRelation" in q._jdf.queryExecution().optimizedPlan().toString() or "__tile" in q._jdf.queryExecution().toString() for q in found)
    assert registry.for_query(again, ["y", "x"]) is None and registry.for_query(again.where("x > 1"), ["x", "y"]) is None


def test_settings_of_the_session_are_checked(spark):
    spark.conf.set("quadrille.join.knn", "magic")
    try:
        with pytest.raises(ValueError):
            Config(spark).get("join.knn")
    finally:
        spark.conf.unset("quadrille.join.knn")


@pytest.mark.parametrize("kind", ["treap", "treemap", "hashmap", "rtree"])
def test_partitions_of_an_index_are_bounded(spark, kind):
    """Half of the rows have one key: no partition has many more rows than index.tileRows, and no row is lost."""
    df = spark.range(4000).selectExpr("id", "cast(if(id % 2 = 0, 3, id % 50) as double) AS x", "1.0D AS y")
    config = Config(spark)
    config.set("index.tileRows", 200)
    try:
        registry = Registry(spark)
        index = registry.create(df, kind, "by_x", ["x", "y"] if kind == "rtree" else ["x"], 4)
        rows = index.data.groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) >= 15 and max(r[1] for r in rows) <= 500
        assert index.rows().count() == 4000
        found = index.equals(3.0) if kind == "hashmap" else index.range([3, 1], [3, 1]) if kind == "rtree" else index.range([3], [3])
        assert found.count() == df.where("x = 3").count() > 2000
        registry.clear()
    finally:
        config.unset("index.tileRows")
