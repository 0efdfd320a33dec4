"""Spatial partitioning: a tile number per row, and DataFrames dealt out by it.

Boundaries come from approximate quantiles, so only they (as many as tiles) reach the driver.
Rows without a tile (a null or NaN coordinate) get -1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.plans.config import Config
from quadrille.plans.storage import column

_ERROR = 0.01


def _below(bounds: list[float], x: Column) -> Column:
    """How many of the bounds are below x."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x))


def _quantiles(df: DataFrame, column: Column, n: int) -> list[float]:
    if n < 2:
        return []
    found = df.select(column.alias("x")).where("x is not null and not isnan(x)").approxQuantile("x", [i / n for i in range(1, n)], _ERROR)
    return sorted(set(found or []))


def str_tiles(df: DataFrame, keys: list[str], tiles: int, name: str = "tile") -> DataFrame:
    """Sort-tile-recursive: slabs of equal counts along the first key, each cut along the next."""
    coords = [F.col(k).cast("double") for k in keys]
    per_dim = max(1, round(tiles ** (1 / len(keys))))
    known = df.where(g.known(coords))
    tile = _below(_quantiles(known, coords[0], per_dim), coords[0])
    for x in coords[1:]:
        steps = F.array(*[F.lit(i / per_dim) for i in range(1, per_dim)]) if per_dim > 1 else None
        if steps is None:
            break
        # One row per slab so far, with its own boundaries along this key.
        found = known.groupBy(tile.alias("slab")).agg(F.percentile_approx(x, steps, F.lit(1000)).alias("b")).collect()
        inner = F.lit(0)
        for row in found:
            inner = F.when(tile == row["slab"], _below(sorted(set(row["b"])), x)).otherwise(inner)
        tile = tile * per_dim + inner
    return df.withColumn(name, F.when(g.known(coords), tile).otherwise(F.lit(-1)))


def kd_tiles(df: DataFrame, keys: list[str], depth: int, name: str = "tile") -> DataFrame:
    """Median splits, the keys in turn: 2 ** depth tiles.

    The medians are a tree in one array (a node's halves are at 2 n + 1 and 2 n + 2), which each row walks
    down, so the expression grows with the number of tiles and no more.
    """
    coords = [F.col(k).cast("double") for k in keys]
    known = df.where(g.known(coords))
    tree: list[float] = []

    def node(levels: int) -> Column:
        if not levels:
            return F.lit(0)
        medians, point = F.array(*map(F.lit, tree)), F.array(*coords)

        def step(at: Column, level: Column) -> Column:
            x = F.get(point, F.pmod(level, F.lit(len(coords))))
            return at * 2 + F.when(x > F.get(medians, at), 2).otherwise(1)

        return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.lit(0), step)

    for level in range(depth):
        x = coords[level % len(coords)]
        found = {r["t"]: r["m"] for r in known.groupBy(node(level).alias("t")).agg(F.percentile_approx(x, 0.5, 1000).alias("m")).collect()}
        # A node without rows has no median; nothing comes by it.
        tree += [found.get(t, math.inf) for t in range(2**level - 1, 2 ** (level + 1) - 1)]
    return df.withColumn(name, F.when(g.known(coords), node(depth) - (2**depth - 1)).otherwise(F.lit(-1)))


def quad_tiles(df: DataFrame, keys: list[str], depth: int, name: str = "tile") -> DataFrame:
    """Equal cells of the extent, numbered along the z-curve: 4 ** depth tiles in two dimensions."""
    coords = [F.col(k).cast("double") for k in keys]
    ends = df.where(g.known(coords)).agg(*[f(x) for x in coords for f in (F.min, F.max)]).first()
    cells = []
    for i, x in enumerate(coords):
        low, span = ends[2 * i], (ends[2 * i + 1] - ends[2 * i]) if ends[2 * i] is not None else 0
        cells.append(F.least(F.floor((x - F.lit(low)) / F.lit(span) * 2**depth), F.lit(2**depth - 1)).cast("long") if span else F.lit(0).cast("long"))
    return df.withColumn(name, F.when(g.known(coords), g.z_value(cells, depth)).otherwise(F.lit(-1)))


def range_tiles(df: DataFrame, key: str, bounds: list[float], name: str = "tile") -> DataFrame:
    """The number of given bounds below the key."""
    x = F.col(key).cast("double")
    return df.withColumn(name, F.when(g.known([x]), _below(sorted(bounds), x)).otherwise(F.lit(-1)))


def voronoi_tiles(df: DataFrame, keys: list[str], pivots: int | None = None, name: str = "tile", seed: int = 42) -> DataFrame:
    """The nearest of a number of pivots that are sampled from the rows (fewer if there are fewer rows)."""
    coords = [F.col(k).cast("double") for k in keys]
    pivots = Config(df.sparkSession).get("voronoi.pivots") if pivots is None else pivots
    known = df.where(g.known(coords)).select(*[x.alias(f"x{i}") for i, x in enumerate(coords)])
    found = known.orderBy(F.xxhash64(F.lit(seed), *known.columns), *known.columns).limit(pivots).collect()
    places = sorted({tuple(r) for r in found})
    if not places:
        return df.withColumn(name, F.lit(-1))
    near = F.array_min(F.array(*[F.struct(g.distance(coords, [F.lit(x) for x in p]).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(places)]))["i"]
    return df.withColumn(name, F.when(g.known(coords), near).otherwise(F.lit(-1)))


def clustered(df: DataFrame, tile: str = "tile", partitions: int | None = None, sort: list[str] = ()) -> DataFrame:
    """Rows dealt out by tile ranges and sorted within, so that scans and cached batches can be skipped by their bounds."""
    order = [tile, *sort]
    # Rows of a hot tile are spread by the sort keys too, and those with the same keys by the whole row.
    return spread(df, order, partitions).sortWithinPartitions(*order)


def spread(df: DataFrame, order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """Rows dealt out by ranges of an order, of about as many rows each; rows that are equal in it are spread by a hash of the row."""
    parts = [column(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    by = [*[column(x) if isinstance(x, str) else x for x in order], F.xxhash64(*parts) if parts else F.lit(0)]
    return df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)


def by_hash(df: DataFrame, key: str, partitions: int) -> DataFrame:
    return df.repartition(partitions, key)


def by_range(df: DataFrame, key: str, partitions: int) -> DataFrame:
    return df.repartitionByRange(partitions, key)


def by_id(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows with an integer key; equal keys go together."""
    return df.repartition(partitions, F.pmod(F.col(key), F.lit(partitions)))


def tiles_for(rows: int, per_tile: int = 1_000_000) -> int:
    return max(1, math.ceil(rows / per_tile))
