"""A registry of named spatial indexes.

An index is the table itself, clustered by its key: `rtree` and `quadtree` by tiles, `treap` and
`treemap` by ranges of one key, `hashmap` by ranges of the key's hash; large tables have more partitions
than tiles, and a key with many rows several of them. It is cached at a storage level, or
persisted as Parquet partitioned by tile. Queries on it are plain filters, so no predicate is ever
lost: the clustering lets Spark skip files, row groups and cached batches.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.operators import filters, partition
from quadrille.plans import predicates
from quadrille.plans.config import Config
from quadrille.plans.storage import column

KINDS = ("rtree", "quadtree", "treap", "treemap", "hashmap")
_TILE = "__tile"


@dataclass
class Index:
    table: str
    name: str
    kind: str
    columns: list[str]
    data: DataFrame
    source: DataFrame | None = None
    level: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)
    path: str = ""
    #: By tile: its number, low and high corner and rows, for pruning by tile number. As many rows as tiles.
    extents: list[tuple] = field(default_factory=list)

    def rows(self) -> DataFrame:
        return self.data.drop(_TILE) if _TILE in self.data.columns else self.data

    def _tiles(self, test) -> DataFrame:
        """The data, restricted to the tiles whose extent passes the test (low, high)."""
        if not self.extents:
            return self.rows()
        hit = [t for t, low, high, _ in self.extents if test(low, high)]
        return self.data.where(F.col(_TILE).isin(hit) if hit else F.lit(False)).drop(_TILE)

    def range(self, low: list[float], high: list[float]) -> DataFrame:
        config = Config(self.data.sparkSession)
        if config.get("index.selectivity") and filters.estimate_selectivity(self.data, self.columns, low, high) > config.get("index.selectivityThreshold"):
            return filters.range_query(self.rows(), self.columns, low, high)  # most tiles qualify: a plain scan
        pruned = self._tiles(lambda a, b: all(x <= hi and y >= lo for x, y, lo, hi in zip(a, b, low, high, strict=True)))
        return filters.range_query(pruned, self.columns, low, high)

    def circle(self, center: list[float], radius: float) -> DataFrame:
        pruned = self._tiles(lambda a, b: sum(max(x - c, 0, c - y) ** 2 for x, y, c in zip(a, b, center, strict=True)) <= (radius * (1 + 1e-9)) ** 2)
        return filters.circle_range(pruned, self.columns, center, radius)

    def knn(self, target: list[float], k: int, tiebreak: list[str] = (), keep_ties: bool = False) -> DataFrame:
        """The k nearest rows, from the tiles that can hold them: those that start no farther away than enough whole tiles end."""
        reach, held = math.inf, 0
        for far, n in sorted((_reach(target, low, high)[1], n) for _, low, high, n in self.extents):
            held += n
            if held >= k:
                reach = far * (1 + 1e-9)
                break
        pruned = self._tiles(lambda a, b: _reach(target, a, b)[0] <= reach)
        return filters.knn(pruned, self.columns, target, k, tiebreak, keep_ties)

    def circles(self, balls: list[tuple[list[float], float]]) -> DataFrame:
        """Rows in all balls, from the tiles that meet each of them."""
        pruned = self._tiles(lambda a, b: all(_reach(center, a, b)[0] <= radius * (1 + 1e-9) for center, radius in balls))
        return filters.circles(pruned, self.columns, balls)

    def circle_count(self, center: list[float], radius: float) -> int:
        """How many rows are in the ball. Tiles that are all inside are counted by their extents and not read."""
        whole = [(t, n) for t, low, high, n in self.extents if _reach(center, low, high)[1] <= radius * (1 - 1e-9)]
        inside = {t for t, _ in whole}
        border = [t for t, low, high, _ in self.extents if t not in inside and _reach(center, low, high)[0] <= radius * (1 + 1e-9)]
        if not self.extents:
            return filters.circle_range(self.rows(), self.columns, center, radius).count()
        rest = filters.circle_range(self.data.where(F.col(_TILE).isin(border)), self.columns, center, radius).count() if border and radius >= 0 else 0
        return sum(n for _, n in whole) + rest

    def where(self, predicate) -> DataFrame:
        """Rows that satisfy a tree of plans.predicates, from the tiles that its disjunctive normal form leaves.

        Nearest neighbours are those of the whole table, whatever stands beside them. The rows of a predicate
        without them are one scan; with them, results of several conjunctions are united as sets.
        """
        config = Config(self.data.sparkSession)
        plain, found = [], None
        for conjunction in predicates.to_dnf(predicate, config.get("predicates.maxTerms")):
            near = [p for p in conjunction if isinstance(p, predicates.InKnn)]
            if any(isinstance(p, predicates.Not) and isinstance(p.a, predicates.InKnn) for p in conjunction):
                raise ValueError("the rows that are no nearest neighbours are filters.without(...)")
            if not near:
                plain.append(conjunction)
                continue
            rows = self.knn(list(near[0].target), near[0].k, list(near[0].tiebreak))
            for p in near[1:]:
                rows = filters.both(rows, self.knn(list(p.target), p.k, list(p.tiebreak)))
            rows = rows.where(_condition([p for p in conjunction if p not in near]))
            found = rows if found is None else filters.either(found, rows)
        if plain:
            bounds = [(predicates.intervals(c, self.columns)[0], [p for p in c if isinstance(p, predicates.InCircle) and list(p.columns) == self.columns]) for c in plain]

            def may_hold(low, high) -> bool:
                return any(
                    all(not i.empty() and x <= i.high and y >= i.low for x, y, i in zip(low, high, intervals, strict=True)) and all(_reach(list(p.center), low, high)[0] <= p.radius * (1 + 1e-9) for p in balls)
                    for intervals, balls in bounds
                )

            test = reduce(lambda a, b: a | b, map(_condition, plain))
            outside = set(self.columns) - {c for p in plain for leaf in p for c in _leaf_columns(leaf)}
            # A row without a tile has an unknown coordinate, and may satisfy what doesn't ask for that.
            rows = (self.rows() if outside or not self.extents else self._tiles(may_hold)).where(test)
            found = rows if found is None else filters.either(found, rows)
        return found

    def equals(self, value) -> DataFrame:
        return self.rows().where(F.col(self.columns[0]) == value)


class Registry:
    """The indexes of a session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._indexes: dict[tuple[str, str], Index] = {}

    def create(self, table: str | DataFrame, kind: str, name: str, columns: list[str], tiles: int | None = None, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Index:
        """Clusters and caches a table (its name in the catalog, or a DataFrame) under an index name."""
        config = Config(self.spark)
        tiles = config.get("index.partitions") if tiles is None else tiles
        df = self.spark.table(table) if isinstance(table, str) else table
        label = table if isinstance(table, str) else f"plan_{df.semanticHash() & 0xFFFFFFFF:08x}"
        if kind not in KINDS:
            raise ValueError(f"unknown index type: {kind}")
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        if kind in ("treap", "treemap", "hashmap") and len(columns) != 1:
            raise ValueError(f"a {kind} index has one column")
        if (label, name) in self._indexes:
            raise ValueError(f"{label} has an index {name}")
        extents: list[tuple] = []
        # A task sorts and caches one partition, so partitions have so many rows at most, whatever the number of tiles.
        parts = max(tiles, partition.tiles_for(df.count(), config.get("index.tileRows")))
        if kind == "hashmap":
            data = partition.spread(df, [F.xxhash64(column(columns[0]))], parts).sortWithinPartitions(columns[0])
        elif kind in ("treap", "treemap"):
            data = partition.spread(df, columns, parts).sortWithinPartitions(columns[0])
        else:
            method = config.get("partition.method") if kind == "rtree" else "quad"
            if method == "str":
                tiled = partition.str_tiles(df, columns, tiles, _TILE)
            elif method == "kd":
                tiled = partition.kd_tiles(df, columns, max(1, round(math.log2(tiles))), _TILE)
            elif method == "voronoi":
                tiled = partition.voronoi_tiles(df, columns, tiles, _TILE)
            else:
                tiled = partition.quad_tiles(df, columns, max(1, round(math.log2(tiles) / len(columns))), _TILE)
            data = partition.clustered(tiled, _TILE, parts, columns)
        data = data.persist(level)
        if _TILE in data.columns:
            extents = _extents(data, columns)
        index = Index(label, name, kind, columns, data, df, level, extents=extents)
        self._indexes[label, name] = index
        return index

    def get(self, table: str, name: str) -> Index:
        return self._indexes[table, name]

    def has(self, table: str, name: str) -> bool:
        return (table, name) in self._indexes

    def find(self, df: DataFrame, name: str | None = None) -> Index | None:
        """The index of a DataFrame with the same plan, and of a name if one is given."""
        for index in self._indexes.values():
            if index.source is not None and (name is None or index.name == name) and index.source.sameSemantics(df):
                return index
        return None

    def for_query(self, df: DataFrame, columns: list[str]) -> Index | None:
        """The index by which a query on these columns of a DataFrame may be answered."""
        return next((i for i in self._indexes.values() if i.source is not None and i.columns == list(columns) and i.source.sameSemantics(df)), None)

    def range(self, df: DataFrame, columns: list[str], low: list[float], high: list[float]) -> DataFrame:
        """filters.range_query of a DataFrame, through an index of it if there is one; so are the others."""
        index = self.for_query(df, columns)
        return index.range(low, high) if index and index.kind != "hashmap" else filters.range_query(df, columns, low, high)

    def circle(self, df: DataFrame, columns: list[str], center: list[float], radius: float) -> DataFrame:
        index = self.for_query(df, columns)
        return index.circle(center, radius) if index and index.extents else filters.circle_range(df, columns, center, radius)

    def knn(self, df: DataFrame, columns: list[str], target: list[float], k: int, tiebreak: list[str] = ()) -> DataFrame:
        index = self.for_query(df, columns)
        return index.knn(target, k, tiebreak) if index and index.extents else filters.knn(df, columns, target, k, tiebreak)

    def show(self, table: str | None = None) -> DataFrame:
        rows = [(i.table, i.name, ",".join(i.columns), i.kind, i.path, str(i.level)) for i in self._indexes.values() if table in (None, i.table)]
        return self.spark.createDataFrame(rows, "table string, name string, columns string, type string, path string, storage string")

    def persist(self, table: str, name: str, path: str) -> None:
        """Writes the index: Parquet by tile, and its description as JSON."""
        index = self._indexes[table, name]
        writer = index.data.write.mode("overwrite")
        (writer.partitionBy(_TILE) if _TILE in index.data.columns else writer).parquet(f"{path}/data")
        about = json.dumps({"table": table, "name": name, "kind": index.kind, "columns": index.columns, "extents": index.extents})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        index.path = path

    def load(self, path: str, name: str | None = None) -> Index:
        """Registers a written index, under a new name if one is given. Its rows are read where they lie."""
        about = json.loads(self.spark.read.text(f"{path}/about").first()[0])
        data = self.spark.read.parquet(f"{path}/data")
        index = Index(about["table"], name or about["name"], about["kind"], about["columns"], data, None, StorageLevel.NONE, path, [tuple(x) for x in about["extents"]])
        self._indexes[index.table, index.name] = index
        return index

    def set_level(self, table: str, name: str, level: StorageLevel) -> None:
        index = self._indexes[table, name]
        index.data.unpersist()
        index.data, index.level = index.data.persist(level), level

    def drop(self, table: str, name: str, blocking: bool = False) -> None:
        self._indexes.pop((table, name)).data.unpersist(blocking)

    def drop_all_of(self, table: str, blocking: bool = False) -> None:
        for key in [k for k in self._indexes if k[0] == table]:
            self.drop(*key, blocking)

    def drop_by_column(self, table: str, column: str) -> None:
        for key in [k for k, i in self._indexes.items() if k[0] == table and column in i.columns]:
            self.drop(*key)

    def clear(self) -> None:
        for key in list(self._indexes):
            self.drop(*key)


def _reach(target: list[float], low: list[float], high: list[float]) -> tuple[float, float]:
    """The least and the greatest distance of a point from a box."""
    sides = list(zip(target, low, high, strict=True))
    return math.sqrt(sum(max(a - x, 0, x - b) ** 2 for x, a, b in sides)), math.sqrt(sum(max(abs(x - a), abs(b - x)) ** 2 for x, a, b in sides))


def _extents(data: DataFrame, columns: list[str]) -> list[tuple]:
    ends = [f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]
    rows = data.where(F.col(_TILE) >= 0).groupBy(_TILE).agg(*ends, F.count("*")).collect()
    return [(r[0], list(r[1:-1:2]), list(r[2:-1:2]), r[-1]) for r in rows]


def _leaf_columns(p) -> tuple[str, ...]:
    p = p.a if isinstance(p, predicates.Not) else p
    return (p.column,) if isinstance(p, predicates.Leaf) else tuple(p.columns)


def _condition(conjunction: list):
    """The Column of a conjunction of leaves."""
    tests = [F.lit(True)]
    for p in conjunction:
        inner = p.a if isinstance(p, predicates.Not) else p
        if isinstance(inner, predicates.Leaf):
            x = column(inner.column)
            test = {"=": x == inner.value, "<": x < inner.value, "<=": x <= inner.value, ">": x > inner.value, ">=": x >= inner.value}[inner.op]
        elif isinstance(inner, predicates.InBox):
            test = g.intersects(g.Point([column(c).cast("double") for c in inner.columns]), g.Box.of(list(inner.low), list(inner.high)))
        elif isinstance(inner, predicates.InCircle):
            test = g.intersects(g.Point([column(c).cast("double") for c in inner.columns]), g.Circle.of(list(inner.center), inner.radius))
        else:
            raise ValueError(f"not a predicate: {p}")
        tests.append(~test if isinstance(p, predicates.Not) else test)
    return reduce(lambda a, b: a & b, tests)
