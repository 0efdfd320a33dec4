"""Typed settings with defaults, kept in the session's configuration under `quadrille.`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Setting:
    default: object
    read: Callable[[str], object]
    valid: Callable[[object], bool]
    doc: str


def _whole(doc: str, default: int) -> Setting:
    return Setting(default, int, lambda v: v > 0, doc)


def _choice(doc: str, default: str, *choices: str) -> Setting:
    return Setting(default, str, lambda v: v in choices, doc)


SETTINGS = {
    "index.partitions": _whole("tiles of an index", 200),
    "join.distance": _choice("strategy of the distance join", "auto", "auto", "grid", "nested_loop", "block", "broadcast"),
    "join.knn": _choice("strategy of the kNN join", "auto", "auto", "grid", "nested_loop", "block", "broadcast", "voronoi", "zorder"),
    "join.partitions": _whole("blocks of pairs in a join of every pair", 64),
    "join.broadcastRows": _whole("right rows up to which a join broadcasts", 1_000_000),
    "join.broadcastBytes": _whole("bytes of right rows up to which a kNN join broadcasts by itself", 256 << 20),
    "zorder.shifts": _whole("shifted curves of an approximate kNN join", 2),
    "zorder.reach": _whole("right rows before and after a left row on a curve that are its candidates, if k isn't more", 8),
    "voronoi.pivots": _whole("pivots of a Voronoi partitioning", 10),
    "sample.rate": Setting(0.01, float, lambda v: 0 < v <= 1, "share of rows in a selectivity estimate"),
    "partition.method": _choice("partitioning of an rtree index", "str", "str", "kd", "quad", "voronoi"),
    "index.tileRows": _whole("rows of an index's partition, which a task sorts and caches: beyond its tiles, an index has as many partitions as that takes", 1_000_000),
    "index.sizeThreshold": _whole("rows up to which a query scans the source and doesn't look for an index", 1),
    "predicates.maxTerms": _whole("terms up to which a predicate is turned into a normal form", 1_000),
    "index.selectivity": Setting(False, lambda s: str(s).lower() == "true", lambda v: isinstance(v, bool), "whether to estimate a query's selectivity first"),
    "index.selectivityThreshold": Setting(0.8, float, lambda v: 0 <= v <= 1, "selectivity beyond which to scan"),
    "grid.slack": Setting(0.001, float, lambda v: 0 < v < 1, "by how much a cell is wider than the join's radius"),
}


class Config:
    def __init__(self, spark: SparkSession) -> None:
        self._conf = spark.conf

    def get(self, key: str, default=None):
        setting = self._setting(key)
        text = self._conf.get(f"quadrille.{key}", None)
        if text is None:
            return setting.default if default is None else default
        return self._read(key, text)

    def set(self, key: str, value) -> None:
        self._read(key, str(value))
        self._conf.set(f"quadrille.{key}", str(value))

    def unset(self, key: str) -> None:
        self._setting(key)
        self._conf.unset(f"quadrille.{key}")

    def all(self) -> dict[str, object]:
        return {k: self.get(k) for k in SETTINGS}

    def _read(self, key: str, text: str):
        """The value of a setting's text; values set in the session directly are checked too."""
        setting = self._setting(key)
        value = setting.read(text)
        if not setting.valid(value):
            raise ValueError(f"{key}: {text} is not allowed")
        return value

    @staticmethod
    def _setting(key: str) -> Setting:
        if key not in SETTINGS:
            raise KeyError(f"no such setting: {key}")
        return SETTINGS[key]
