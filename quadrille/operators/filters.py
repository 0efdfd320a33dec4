"""Range, circle and nearest-neighbour selection.

Keys are a list of coordinate columns, or one shape column turned into a shape by the caller. A row
with a null or NaN coordinate never qualifies. Every circle comes with its bounding box as a
conjunct, so that it reaches the parquet scan. Nearest neighbours are a relational operator: the k
rows of exactly the DataFrame that is given, ties broken by `tiebreak` columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.plans.config import Config


def _point(df: DataFrame, keys: list[str]) -> g.Point:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return g.Point([F.col(k).cast("double") for k in keys])


def _shape(df: DataFrame, key):
    return _point(df, key) if isinstance(key, list) else key


def range_query(df: DataFrame, key, low: list[float], high: list[float]) -> DataFrame:
    """Rows whose point is in the closed box, or whose shape meets it."""
    box = g.Box.of(low, high)
    if not isinstance(key, list):
        return df.where(g.intersects(key, box))
    _point(df, key)
    g._same_dims(key, low)
    # Plain comparisons with the stored columns are pushed to the scan; NaN is above any bound.
    test = F.lit(True)
    for k, lo, hi in zip(key, low, high, strict=True):
        test = test & (F.col(k) >= lo) & (F.col(k) <= hi)
    return df.where(test & g.known(_point(df, key).coords))


def circle_range(df: DataFrame, key, center: list[float], radius: float) -> DataFrame:
    """Rows within the closed ball; none for a negative radius."""
    if radius < 0:
        return df.limit(0)
    ball = g.Circle.of(center, radius)
    if not isinstance(key, list):
        return df.where(g.intersects(key, ball))
    slack = radius * (1 + 1e-9)
    near = range_query(df, key, [c - slack for c in center], [c + slack for c in center])
    return near.where(g.intersects(_point(df, key), ball))


def circles(df: DataFrame, key, balls: list[tuple[list[float], float]]) -> DataFrame:
    """Rows within all balls."""
    for center, radius in balls:
        df = circle_range(df, key, center, radius)
    return df


def knn(df: DataFrame, key, target: list[float], k: int, tiebreak: list[str] = (), keep_ties: bool = False, dist_col: str | None = None, distance: Callable[..., Column] | None = None) -> DataFrame:
    """The k nearest rows. keep_ties: also all rows at the k-th distance. distance: of the key's shape to the target, if not Euclidean."""
    shape = _shape(df, key)
    aim = g.Point.of(*target)
    dist = distance(shape, aim) if distance else g.min_dist(shape, aim)
    name = dist_col or "__dist"
    rows = df.withColumn(name, dist).where(F.col(name).isNotNull() & ~F.isnan(name))
    if k <= 0:
        rows = rows.limit(0)
    elif keep_ties:
        # The k-th distance first, by a bounded top-k; then one scan.
        last = rows.select(name).orderBy(name).limit(k).agg(F.max(name).alias("__last"))
        rows = rows.join(F.broadcast(last), F.col(name) <= F.col("__last")).drop("__last")
    else:
        rows = rows.orderBy(name, *tiebreak).limit(k)
    return rows if dist_col else rows.drop(name)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both results, as sets."""
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of the results, as sets."""
    return a.union(b).distinct()


def without(df: DataFrame, a: DataFrame) -> DataFrame:
    """Rows of df that are not in a, as sets."""
    return df.subtract(a)


def rank_of(df: DataFrame, key: str, value) -> DataFrame:
    """One row: how many keys are at most the value."""
    return df.where(F.col(key) <= value).agg(F.count("*").alias("rank"))


def ranks(df: DataFrame, key: str) -> DataFrame:
    """Each different key with its multiplicity and its rank (rows with a key at most this)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    # Ranges of keys get partial sums, so no task sees all keys.
    parts = counts.repartitionByRange(key).withColumn("__part", F.spark_partition_id())
    upto = F.sum("n").over(Window.partitionBy("__part").orderBy(key))
    local = parts.withColumn("__upto", upto).persist()
    totals = local.groupBy("__part").agg(F.sum("n").alias("__n"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before), "__part").select(key, "n", (F.col("__upto") + F.col("__before")).alias("rank"))


def count_of(df: DataFrame, key: str, value) -> int:
    """The key's multiplicity, -1 if it is absent."""
    n = df.where(F.col(key) == value).count()
    return n or -1


def estimate_selectivity(df: DataFrame, keys: list[str], low: list[float], high: list[float], fraction: float | None = None, seed: int = 42) -> float:
    """The share of rows in the box, from a sample; for choosing between an index and a scan."""
    fraction = Config(df.sparkSession).get("sample.rate") if fraction is None else fraction
    inside = F.lit(True)
    for k, lo, hi in zip(keys, low, high, strict=True):
        inside = inside & F.col(k).between(lo, hi)
    n, hit = df.sample(fraction=fraction, seed=seed).agg(F.count("*"), F.sum(inside.cast("int"))).first()
    return (hit or 0) / n if n else 1.0
