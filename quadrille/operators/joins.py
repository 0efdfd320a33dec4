"""Distance joins, joins of shapes, and k-nearest-neighbour joins.

Keys are a list of coordinate columns, or (name, dimensions) of one column of points. Results have
the left columns, then the right ones; clashing names get `suffixes`, and any names are allowed. Rows with
a null or NaN coordinate match nothing. All exact strategies return the same rows; `auto` is what the
settings join.distance and join.knn say.

Distance join. `grid`: cells a little wider than r; the rows of the larger side go to their cell, those of
the smaller one to their cell and the ones beside it (in two dimensions at most), and an equality join on
the cell finds every pair once. It is a merge join always, as the optimiser doesn't see that a side is repeated
and would broadcast it. `broadcast`: every pair, with the right side broadcast, which is refused
above the setting join.broadcastRows. `block`: blocks of 1,024 rows that are next to each other on a z-curve, and
every pair of rows from blocks within r of each other. `nested_loop` is `broadcast` for few pairs and else `block`.
A dense cell makes a hot key: adaptive skew handling splits it, and `salt` deals each left cell to that many keys.

Shape join. Each shape goes to the cells that its box covers on the level of its size, and on the coarser
levels that other shapes have, so it is in few cells of each; a pair meets on the coarser of its two levels,
in the one cell with the corner where their boxes begin to overlap. Cells have the proportions of a typical box;
cells with many rows are dealt to pieces that meet each other.

kNN join. `broadcast`: the right keys on every executor, up to the settings join.broadcastRows and
join.broadcastBytes (counted before anything is collected), searched by cells around each left row.
`grid`: exact for any size. Cells double in width until the block of cells around a left cell holds k
right rows, which bounds the cells that are joined; all levels are found in one plan and joined by one
equality join. Right rows in one place are cut to the k first by tiebreak (no left row can have more of
them). `voronoi`: both sides go to the nearest of some pivots, and right rows to all left cells that they
can reach by the triangle inequality. `block` (or `nested_loop`): blocks as above; a left block gets all right
blocks that can hold a neighbour of its rows. A group of these two is searched by cells in one worker, so that
pairs are never made. All but `broadcast` search for the places of left rows, each place once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from quadrille.functions import geometry as g
from quadrille.plans.config import Config
from quadrille.plans.storage import checkpointed, column

#: Beyond this many cells from the origin, cells are one: quotients so large are not exact.
_FAR = 1e12
#: Pairs up to which a nested loop compares every one.
_PAIRS = 100_000_000
#: What a scan reads in one task by default.
_FILE_BYTES = 128 << 20
#: Rows of a side that meet by one key of a shape join.
_KEY_ROWS = 20_000
#: Widths of cells double up to this level.
_LEVELS = 60
#: Candidates that a worker compares at a time; places that it searches for at a time; right rows that it holds at a time.
_CANDIDATES, _PLACES, _HELD = 500_000, 2_000, 200_000
#: Rows of a block: two to the power of this.
_BLOCK_BITS = 10
#: Rows to a pivot, and how many pivots there are at most, unless voronoi.pivots is more.
_PIVOT_ROWS, _PIVOTS = 20_000, 2_000


def _named(left: DataFrame, right: DataFrame, suffixes: tuple[str, str]) -> tuple[DataFrame, DataFrame, dict, dict]:
    clash = set(left.columns) & set(right.columns)
    a = {c: c + suffixes[0] if c in clash else c for c in left.columns}
    b = {c: c + suffixes[1] if c in clash else c for c in right.columns}
    if set(a.values()) & set(b.values()):
        raise ValueError("the suffixes leave clashing names")
    return left.select(*[column(c).alias(n) for c, n in a.items()]), right.select(*[column(c).alias(n) for c, n in b.items()]), a, b


Keys = list[str] | tuple[str, int]


def _keys(keys: Keys, names: dict) -> list[Column]:
    missing = [k for k in (keys[:1] if isinstance(keys, tuple) else keys) if k not in names]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    if isinstance(keys, tuple):
        return g.Point.from_array(column(names[keys[0]]), keys[1]).coords
    return [column(names[k]).cast("double") for k in keys]


def _packed(df: DataFrame, name: str, **others: Column) -> DataFrame:
    """The row as one column and others beside it, so that no name in the row can clash."""
    return df.select(F.struct(*map(column, df.columns)).alias(name), *[x.alias(n) for n, x in others.items()])


def _out(left: DataFrame, right: DataFrame, dist_col: str | None) -> list[Column]:
    """The result's columns, from the packed rows `l` and `r` and the distance `d`."""
    rows = [F.col(f"{side}.`{c.replace('`', '``')}`").alias(c) for side, df in (("l", left), ("r", right)) for c in df.columns]
    return [*rows, *([F.col("d").alias(dist_col)] if dist_col else [])]


def _cell(x: Column, width: Column | float) -> Column:
    width = width if isinstance(width, Column) else F.lit(width)
    return F.floor(F.least(F.greatest(x / width, F.lit(-_FAR)), F.lit(_FAR))).cast("long")


def _bytes(df: DataFrame) -> int:
    """What the optimiser takes the rows for."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _around(dims: int) -> Column:
    return F.array(*[F.struct(*[F.lit(o).alias(f"o{k}") for k, o in enumerate(offset)]) for offset in itertools.product((-1, 0, 1), repeat=dims)])


def _z_order(ends: list, dims: int):
    """A function of coordinates and offsets that gives a row's value on the z-curve over an extent: (low, high) of each side and dimension."""
    bits = min(20, 62 // dims)
    lows = [min((e[2 * i] for e in ends if e[2 * i] is not None), default=0.0) for i in range(dims)]
    spans = [max((e[2 * i + 1] for e in ends if e[2 * i + 1] is not None), default=0.0) - lo or 1.0 for i, lo in enumerate(lows)]
    return lambda coords, offset: g.z_value([F.floor((((x - lo) / span + o) / 2) * (2**bits - 1)).cast("long") for x, lo, span, o in zip(coords, lows, spans, offset, strict=True)], bits)


def _extent(df: DataFrame, coords: list[Column]) -> tuple:
    return df.agg(*[f(x) for x in coords for f in (F.min, F.max)]).first()


def _blocked(df: DataFrame, name: str, coords: list[Column], z) -> tuple[DataFrame, DataFrame]:
    """df with the number of each row's block under a name, and the blocks' boxes. A block is 1,024 rows at most that follow each other on the z-curve."""
    order = [z(coords, [0.0] * len(coords)).alias("z"), F.xxhash64(*coords).alias("h")]
    dealt = df.select("*", *order).repartitionByRange("z", "h").sortWithinPartitions("z", "h")
    df = checkpointed(dealt.withColumn(name, F.shiftright(F.monotonically_increasing_id(), _BLOCK_BITS)).drop("z", "h"))
    ends = F.array(*[f(x) for f in (F.min, F.max) for x in coords])
    return df, df.groupBy(name).agg(ends.alias("box"), F.count("*").alias("n"))


def _near_blocks(left: DataFrame, right: DataFrame, dims: int, r: float | None = None, k: int = 0) -> DataFrame:
    """(lb, rb): the blocks within r of each other, or those that can hold one of the k nearest right rows of a row in the left block.

    The right boxes, one for 1,024 rows, are on every executor.
    """
    boxes = right.toArrow()
    there = boxes["rb"].to_numpy(), np.array(boxes["box"].combine_chunks().flatten()).reshape(-1, 2, dims), boxes["n"].to_numpy()
    shared = left.sparkSession.sparkContext.broadcast(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, corners, counts = shared.value
        for batch in batches if len(numbers) else ():
            own = np.array(batch.column(1).flatten()).reshape(-1, 2, dims)
            for number, (low, high) in zip(batch.column(0).to_numpy(), own, strict=True):
                gap = np.maximum(np.maximum(corners[:, 0] - high, low - corners[:, 1]), 0)
                reach = r
                if reach is None:
                    far = np.sqrt((np.maximum(corners[:, 1] - low, high - corners[:, 0]) ** 2).sum(axis=1))
                    by = np.argsort(far)
                    reach = far[by[min(np.searchsorted(np.cumsum(counts[by]), k), len(by) - 1)]]
                hit = numbers[np.sqrt((gap**2).sum(axis=1)) <= reach * (1 + 1e-9)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), number)), pa.array(hit)], ["lb", "rb"])

    return checkpointed(left.select("lb", "box").mapInArrow(run, "lb long, rb long"))


def _block_pairs(left: DataFrame, right: DataFrame, kl: list[Column], kr: list[Column], r: float) -> DataFrame:
    """Every pair of rows from blocks within r of each other. Each pair of blocks is a key of its own, so no key has more than 1,024 rows a side."""
    z = _z_order([_extent(left, kl), _extent(right, kr)], len(kl))
    (left, own), (right, other) = _blocked(left, "lb", kl, z), _blocked(right, "rb", kr, z)
    near = _near_blocks(own, other, len(kl), r)
    return left.join(near.hint("merge"), "lb").join(right.join(near.hint("merge"), "rb").hint("merge"), ["lb", "rb"])


def _few_pairs(left: DataFrame, right: DataFrame) -> bool:
    """Whether every pair of rows may be compared; of a stream's, the right rows are what counts."""
    n = right.count()
    return n <= Config(right.sparkSession).get("join.broadcastRows") and (left.isStreaming or n * left.count() <= _PAIRS)


def _check_rows(df: DataFrame) -> None:
    most = Config(df.sparkSession).get("join.broadcastRows")
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are too many to broadcast; join.broadcastRows is {most}")


def distance_join(left: DataFrame, right: DataFrame, left_keys: Keys, right_keys: Keys, r: float, strategy: str = "auto", suffixes: tuple[str, str] = ("_l", "_r"), dist_col: str | None = None, salt: int = 1, how: str = "inner") -> DataFrame:
    """Pairs at distance r or less. how: also `left` (left rows without a pair too), `left_semi` and `left_anti` (left rows with or without one, with their own columns)."""
    if strategy not in ("auto", "grid", "nested_loop", "broadcast", "block"):
        raise ValueError(f"unknown strategy: {strategy}")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join: {how}")
    config = Config(left.sparkSession)
    strategy = config.get("join.distance") if strategy == "auto" else strategy
    if how != "inner" and strategy in ("nested_loop", "block"):
        raise ValueError(f"the strategy {strategy} gives pairs only")
    names = left.columns
    left, right, a, b = _named(left, right, suffixes)
    lk, rk = _keys(left_keys, a), _keys(right_keys, b)
    g._same_dims(lk, rk)
    right = right.where(g.known(rk))
    if how in ("inner", "left_semi"):  # the others keep left rows that match nothing
        left = left.where(g.known(lk))
    dims = len(lk)
    packed = [_packed(df, name, **{f"{name}{i}": x for i, x in enumerate(keys)}) for df, name, keys in ((left, "l", lk), (right, "r", rk))]
    pl, pr = packed
    kl, kr = ([F.col(f"{name}{i}") for i in range(dims)] for name in "lr")
    dist = g.distance(kl, kr)
    if r < 0:
        pairs = pl.join(pr, F.lit(False), how)
    elif strategy == "broadcast" or (strategy == "nested_loop" and _few_pairs(left, right)):
        _check_rows(right)
        pairs = pl.join(F.broadcast(pr), dist <= r, how)
    elif strategy in ("nested_loop", "block"):
        pairs = _block_pairs(pl, pr, kl, kr, r).where(dist <= r)
    elif r == 0:
        # Negative zero equals zero; adding zero makes it so for the join's hash too.
        pairs = pl.join(pr.hint("merge"), [x + 0.0 == y + 0.0 for x, y in zip(kl, kr, strict=True)], how)
    else:
        width, used = r * (1 + config.get("grid.slack")), min(2, dims)
        # The side that the optimiser takes for the smaller one is repeated; of a stream's, the other; the right one where left rows count by themselves.
        repeat_left = how == "inner" and (right.isStreaming or (not left.isStreaming and _bytes(left) < _bytes(right)))
        sides = []
        for df, name, keys, repeats in ((pl, "l", kl, repeat_left), (pr, "r", kr, not repeat_left)):
            cells = [_cell(x, width) for x in keys[:used]]
            if repeats:
                df = df.withColumn("o", F.explode(_around(used)))
                cells = [c + F.col(f"o.o{k}") for k, c in enumerate(cells)]
            sides.append(df.withColumns({f"{name}c{k}": c for k, c in enumerate(cells)}).drop("o"))
        pl, pr = sides
        same = [F.col(f"lc{k}") == F.col(f"rc{k}") for k in range(used)]
        if salt > 1:
            pl = pl.withColumn("ls", F.pmod(F.xxhash64(*kl, F.monotonically_increasing_id()), F.lit(salt)).cast("int"))
            pr = pr.withColumn("rs", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
            same.append(F.col("ls") == F.col("rs"))
        # The optimiser doesn't see that a side is repeated, and would broadcast it by the size of its files.
        pairs = pl.join(pr.hint("merge"), [*same, dist <= r], how)
    if how in ("left_semi", "left_anti"):
        return pairs.select(*[F.col(f"l.`{a[c].replace('`', '``')}`").alias(c) for c in names])
    return pairs.withColumn("d", dist).select(*_out(left, right, dist_col))


def shape_join(left: DataFrame, right: DataFrame, left_shape, right_shape, r: float = 0.0, suffixes: tuple[str, str] = ("_l", "_r"), dist_col: str | None = None) -> DataFrame:
    """Pairs of rows whose shapes meet, or are at distance r or less. The shapes (of two dimensions or more) are made by functions of a column getter."""
    left, right, a, b = _named(left, right, suffixes)
    rows = []
    ends = [f"{e}{k}" for e in "xy" for k in range(2)]
    sizes = []
    for df, name, names, shape in ((left, "l", a, left_shape), (right, "r", b, right_shape)):
        box = g.box_of(shape(lambda c, names=names: column(names[c])))
        half = F.lit(r / 2 * (1 + 1e-9))
        at = [*[x - half for x in box.low[:2]], *[y + half for y in box.high[:2]]]
        packed = _packed(df, name, **{f"{name}{e}": x for e, x in zip(ends, at, strict=True)})
        rows.append(packed.where(g.known([F.col(f"{name}{e}") for e in ends])))
        spans = [F.col(f"{name}y{k}") - F.col(f"{name}x{k}") for k in range(2)]
        sizes.append(rows[-1].agg(*[F.avg(F.when((x > 0) & (x < 1e300), F.log2(x))) for x in spans]).first())
    # Cells have the proportions of the boxes: a box's typical size in each dimension, on the side where it is larger.
    units = [2.0 ** max((x[k] for x in sizes if x[k] is not None), default=0.0) * (1 + 1e-6) for k in range(2)]
    for i, name in enumerate("lr"):
        size = F.greatest(*[(F.col(f"{name}y{k}") - F.col(f"{name}x{k}")) / units[k] for k in range(2)])
        # A power of two that is no smaller than the box: it covers two cells of this width in a dimension at most.
        level = F.greatest(F.lit(-_LEVELS), F.least(F.lit(_LEVELS), F.ceil(F.log2(F.greatest(size, F.lit(1e-300)))))).cast("int")
        rows[i] = rows[i].withColumn(f"{name}v", level)
    # As many rows as there are powers of two between the sizes of boxes. No level is finer than half of the boxes of a side need.
    sizes = rows[0].select(F.lit(0).alias("side"), F.col("lv").alias("v")).unionByName(rows[1].select(F.lit(1).alias("side"), F.col("rv").alias("v")))
    found = sizes.groupBy("side", "v").agg(F.count("*").alias("n")).orderBy("side", "v").collect()
    finest = -_LEVELS
    for side in range(2):
        mine = [(x["v"], x["n"]) for x in found if x["side"] == side]
        upto = itertools.accumulate(n for _, n in mine)
        finest = max([finest, *[v for (v, _), so_far in zip(mine, upto, strict=True) if 2 * so_far >= sum(n for _, n in mine)][:1]])
    levels = sorted({max(x["v"], finest) for x in found})
    rows = [df.withColumn(f"{n}v", F.greatest(f"{n}v", F.lit(finest))) for df, n in zip(rows, "lr", strict=True)]
    if not levels:
        levels = [0]
    parts = []
    for df, n in zip(rows, "lr", strict=True):
        df = df.withColumn(f"{n}w", F.explode(_levels_from(levels, F.col(f"{n}v"))))
        for k in range(2):
            first, last = (_cell(F.col(f"{n}{e}{k}"), F.pow(F.lit(2.0), F.col(f"{n}w")) * units[k]) for e in "xy")
            df = df.withColumn(f"{n}f{k}", first).withColumn(f"{n}c{k}", F.explode(F.sequence(F.col(f"{n}f{k}"), last)))
        parts.append(df)
    pl, pr, same = _dealt(*parts, ["w", "c0", "c1"])
    # The boxes begin to overlap in the cell where the later one begins. Cheap tests come first.
    meet = [F.greatest("lv", "rv") == F.col("lw"), *[F.col(f"{p}x{k}") <= F.col(f"{q}y{k}") for k in range(2) for p, q in ("lr", "rl")], *[F.greatest(f"lf{k}", f"rf{k}") == F.col(f"lc{k}") for k in range(2)]]
    one, other = (shape(lambda c, n=n, names=names: F.col(f"{n}.`{names[c].replace('`', '``')}`")) for shape, n, names in ((left_shape, "l", a), (right_shape, "r", b)))
    test = g.intersects(one, other) if r == 0 else g.min_dist(one, other) <= r
    found = pl.join(pr.hint("merge"), [*same, *meet, test])
    return (found.withColumn("d", g.min_dist(one, other)) if dist_col else found).select(*_out(left, right, dist_col))


def _dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both sides and the equalities of a join by keys, where no key has more than some rows of a side, as those of hot keys are dealt to pieces and each piece meets each."""
    counts = [df.groupBy(*[F.col(f"{n}{x}").alias(x) for x in keys]).agg(F.count("*").alias(n)) for df, n in ((left, "l"), (right, "r"))]
    pieces = [F.ceil(F.col(n) / _KEY_ROWS).cast("int").alias(f"{n}n") for n in "lr"]
    hot = checkpointed(counts[0].join(counts[1].hint("merge"), keys).where(F.greatest("l", "r") > _KEY_ROWS).select(*keys, *pieces))
    same = [F.col(f"l{x}") == F.col(f"r{x}") for x in keys]
    if hot.isEmpty():
        return left, right, same
    sides = []
    for df, n, own, other in ((left, "l", "ln", "rn"), (right, "r", "rn", "ln")):
        df = df.join(F.broadcast(hot), [F.col(f"{n}{x}") == hot[x] for x in keys], "left")
        df = df.withColumn(f"{n}i", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(own, F.lit(1))))
        df = df.withColumn(f"{n}j", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        sides.append(df.drop(*keys, "ln", "rn"))
    return *sides, [*same, F.col("li") == F.col("rj"), F.col("lj") == F.col("ri")]


def _levels_from(levels: list[int], least: Column) -> Column:
    return F.filter(F.array(*map(F.lit, levels)), lambda v: v >= least)


def knn_join(left: DataFrame, right: DataFrame, left_keys: Keys, right_keys: Keys, k: int, tiebreak: list[str] = (), strategy: str = "auto", suffixes: tuple[str, str] = ("_l", "_r"), dist_col: str | None = None) -> DataFrame:
    """For each left row, its k nearest right rows; ties by the right columns of `tiebreak`. Left duplicates each get theirs."""
    if strategy not in ("auto", "grid", "nested_loop", "block", "broadcast", "voronoi", "zorder"):
        raise ValueError(f"unknown strategy: {strategy}")
    config = Config(left.sparkSession)
    strategy = config.get("join.knn") if strategy == "auto" else strategy
    if strategy == "zorder":
        return zknn_join(left, right, left_keys, right_keys, k, tiebreak, suffixes=suffixes, dist_col=dist_col)
    left, right, a, b = _named(left, right, suffixes)
    lk, rk = _keys(left_keys, a), _keys(right_keys, b)
    g._same_dims(lk, rk)
    left, right = left.where(g.known(lk)), right.where(g.known(rk))
    out = _out(left, right, dist_col)
    pl = _packed(left, "l", p=F.array(*lk))
    pr = _packed(right, "r", q=F.array(*rk), t=F.struct(F.lit(0).alias("_"), *[column(b[t]) for t in tiebreak]))
    if k <= 0:
        return pl.join(pr, F.lit(False)).withColumn("d", F.lit(0.0)).select(*out)
    dims = len(lk)
    if strategy == "auto":
        strategy = "broadcast" if _fits(pr, config) else "grid"
    elif strategy == "broadcast" and not _fits(pr, config, bytes_too=False):
        raise ValueError("the right rows are too many to broadcast; see join.broadcastRows")
    if strategy == "broadcast":
        return _broadcast_knn(pl, pr, k, dims).select(*out)
    pl, pr = checkpointed(pl), _numbered(pr, k, bool(tiebreak))
    # Left rows in one place have the same neighbours, so places are searched for, and not rows.
    places, points = checkpointed(pl.select("p").distinct()), pr.select("rid", "q")
    if strategy in ("nested_loop", "block"):
        near = _block_knn(places, points, k, dims)
    elif strategy == "voronoi":
        near = _voronoi_knn(places, points, k, dims)
    else:
        near = _nearest(_grid_candidates(places, points, k, dims), k, dims)
    # The optimiser doesn't know the sizes of these, and would broadcast them by those of files.
    return near.select("p", "rid", "d").join(pl.hint("merge"), "p").join(pr.hint("merge"), "rid").select(*out)


def _numbered(right: DataFrame, k: int, ordered: bool) -> DataFrame:
    """Right rows with numbers `rid` in the order of `t`; of those in one place, the k first (no left row can have more of them)."""
    first = Window.partitionBy("q").orderBy("t")
    kept = right.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")
    return checkpointed((kept.orderBy("t", F.xxhash64("q")) if ordered else kept).withColumn("rid", F.monotonically_increasing_id()))


def _coords(name: str, dims: int) -> list[Column]:
    return [F.get(F.col(name), F.lit(i)) for i in range(dims)]


def _nearest(pairs: DataFrame, k: int, dims: int) -> DataFrame:
    """The k nearest right rows of each left place `p`, from candidates (p, q, rid)."""
    nearest = Window.partitionBy("p").orderBy("d", "rid")
    with_d = pairs.withColumn("d", g.distance(_coords("p", dims), _coords("q", dims)))
    return with_d.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k)


def _local_knn(left: DataFrame, right: DataFrame, k: int, dims: int) -> DataFrame:
    """(p, rid, d): of each left place (g, p) the k nearest of the right rows (g, rid, q) of its group; ties by rid.

    A worker holds the places of one group, their k best and a bounded number of right rows.
    """
    spark = left.sparkSession
    n = max(Config(spark).get("join.partitions"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = left.select("g", F.lit(0).alias("side"), F.col("p").alias("x"), F.lit(0).cast("long").alias("rid")).unionByName(right.select("g", F.lit(1).alias("side"), F.col("q").alias("x"), "rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, 0
        places: list[np.ndarray] = []
        points: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        near = away = None

        def merge() -> None:
            nonlocal near, away, held
            if held and places:
                numbers, there = np.concatenate(ids), np.concatenate(points)
                by = np.argsort(numbers)
                here = places[0] = np.concatenate(places)
                del places[1:]
                found, d = CellIndex(there[by], k).nearest(here)
                found = numbers[by][found]
                if near is not None:
                    found, d = np.concatenate([near, found], axis=1), np.concatenate([away, d], axis=1)
                    best = np.lexsort((found, d), axis=1)[:, :k]
                    found, d = np.take_along_axis(found, best, axis=1), np.take_along_axis(d, best, axis=1)
                near, away = found, d
            held = 0
            points.clear()
            ids.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal near, away
            merge()
            if near is not None:
                width = near.shape[1]
                step = max(1, 100_000 // width)
                for a in range(0, len(near), step):
                    some = np.repeat(places[0][a : a + step], width, axis=0)
                    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(some.ravel())), pa.array(near[a : a + step].ravel()), pa.array(away[a : a + step].ravel())], ["p", "rid", "d"])
            near = away = None
            places.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, side, numbers = (batch.column(i).to_numpy() for i in (0, 1, 3))
            x = np.array(batch.column(2).flatten()).reshape(-1, dims)
            ends = np.flatnonzero((groups[1:] != groups[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in itertools.pairwise([0, *ends.tolist(), len(x)]):
                if groups[a] != group:
                    yield from finish()
                    group = groups[a]
                if side[a] == 0:
                    places.append(x[a:b])
                else:
                    points.append(x[a:b])
                    ids.append(numbers[a:b])
                    held += b - a
                    if held >= _HELD:
                        merge()
        yield from finish()

    return both.repartition(n, "g").sortWithinPartitions("g", "side").mapInArrow(run, "p array<double>, rid long, d double")


def _fits(right: DataFrame, config: Config, bytes_too: bool = True) -> bool:
    """Whether the right rows may be broadcast: they are counted, and measured only if they are few."""
    if right.count() > config.get("join.broadcastRows"):
        return False
    # The rows as text are longer than as values, so this is a bound of what is sent.
    return not bytes_too or (right.agg(F.sum(F.length(F.to_json("r")))).first()[0] or 0) <= config.get("join.broadcastBytes")


def _first_of_places(points: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the points without those that have k before them in the same place."""
    by = np.lexsort((np.arange(len(points)), *points.T))
    new = np.ones(len(points), bool)
    new[1:] = (points[by[1:]] != points[by[:-1]]).any(axis=1)
    begins = np.flatnonzero(new)
    place = np.arange(len(points)) - np.repeat(begins, np.diff(np.append(begins, len(points))))
    return np.sort(by[place < k])


class CellIndex:
    """Points by cells of about equal counts, for the k nearest ones of many places at a time; ties by the points' order."""

    def __init__(self, points: np.ndarray, k: int) -> None:
        self.k = min(k, len(points))
        self.numbers = _first_of_places(points, k)
        self.points = points = points[self.numbers]
        spans = points.max(axis=0) - points.min(axis=0)
        self.used = [int(i) for i in np.argsort(-spans, kind="stable")[:2] if spans[i] > 0]
        per_dim = max(1, int((len(points) / max(8, 2 * k)) ** (1 / max(1, len(self.used)))))
        #: Where the cells begin in each dimension, but for the first.
        self.bounds = [np.unique(np.quantile(points[:, i], np.arange(1, per_dim) / per_dim)) for i in self.used]
        self.sizes = [len(b) + 1 for b in self.bounds]
        cell = np.zeros(len(points), np.int64)
        for i, b, n in zip(self.used, self.bounds, self.sizes, strict=True):
            cell = cell * n + np.searchsorted(b, points[:, i], side="right")
        self.order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[self.order], np.arange(math.prod(self.sizes) + 1))

    def nearest(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the k nearest points of each place, nearest first."""
        near, away = np.zeros((len(places), self.k), np.int64), np.zeros((len(places), self.k))
        for begin in range(0, len(places), _PLACES):
            some = slice(begin, begin + _PLACES)
            self._search(places[some], near[some], away[some])
        return self.numbers[near], away

    def _search(self, places: np.ndarray, near: np.ndarray, away: np.ndarray) -> None:
        """Bounds the k-th distance by as many cells around as have k points, and then looks at the cells in that reach."""
        left, around = np.arange(len(places)), 1
        while len(left):
            runs = self._around(places[left], around)
            totals = np.bincount(runs[0], runs[2], len(left))
            enough = totals >= self.k
            mine = enough[runs[0]]
            self._best(places, left[enough], (np.cumsum(enough) - 1)[runs[0][mine]], runs[1][mine], runs[2][mine], near, away)
            left, around = left[~enough], around * 2
        self._best(places, np.arange(len(places)), *self._within(places, away[:, -1]), near, away)

    def _runs(self, first: list[np.ndarray], last: list[np.ndarray], n: int, room=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of cells of each place: its number, where the run's points begin, and how many they are. room(owner, line): the ends of a line's run, if they differ."""
        if not self.used:
            return np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.points))
        if len(self.used) == 1:
            begins = self.starts[first[0]]
            return np.arange(n), begins, self.starts[last[0] + 1] - begins
        lines = last[0] - first[0] + 1
        owner = np.repeat(np.arange(n), lines)
        line = np.arange(len(owner)) - np.repeat(np.cumsum(lines) - lines, lines) + first[0][owner]
        low, high = room(owner, line) if room else (first[1][owner], last[1][owner])
        begins = self.starts[line * self.sizes[1] + low]
        return owner, begins, self.starts[line * self.sizes[1] + high + 1] - begins

    def _around(self, places: np.ndarray, around: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = [np.searchsorted(b, places[:, i], side="right") for i, b in zip(self.used, self.bounds, strict=True)]
        return self._runs([np.maximum(a - around, 0) for a in at], [np.minimum(a + around, n - 1) for a, n in zip(at, self.sizes, strict=True)], len(places))

    def _within(self, places: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells that may have a point at the reach or nearer; one at just that distance may win a tie."""
        reach = reach * (1 + 1e-9)
        ends = [[np.searchsorted(b, places[:, i] + side * reach, side="right") for side in (-1, 1)] for i, b in zip(self.used, self.bounds, strict=True)]

        def room(owner: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            (i, j), edges = self.used, np.concatenate([[-np.inf], self.bounds[0], [np.inf]])
            x = places[owner, i]
            gap = np.maximum(np.maximum(edges[line] - x, x - edges[line + 1]), 0)
            square = reach[owner] * reach[owner]
            rest = np.where(np.isfinite(square), np.sqrt(np.maximum(square - gap * gap, 0)) * (1 + 1e-9), np.inf)
            return tuple(np.searchsorted(self.bounds[1], places[owner, j] + side * rest, side="right") for side in (-1, 1))

        return self._runs([e[0] for e in ends], [e[1] for e in ends], len(places), room)

    def _best(self, places: np.ndarray, rows: np.ndarray, owner: np.ndarray, begins: np.ndarray, counts: np.ndarray, near: np.ndarray, away: np.ndarray) -> None:
        """The k nearest points of the runs of each of the rows, which all have k or more."""
        mine = places[rows]
        upto, runs = np.cumsum(np.bincount(owner, counts, len(rows)).astype(np.int64)), np.searchsorted(owner, np.arange(len(rows) + 1))
        begin = 0
        while begin < len(rows):  # as many rows at a time as bound the candidates
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _CANDIDATES, side="right")))
            some = slice(runs[begin], runs[end])
            n = counts[some]
            at = np.repeat(begins[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            row, point = np.repeat(owner[some], n), self.order[at]
            square = np.zeros(len(row))
            for i in range(self.points.shape[1]):
                gap = mine[row, i] - self.points[point, i]
                square += gap * gap
            d = np.sqrt(square)
            by = np.lexsort((point, d, row))
            row, point, d = row[by], point[by], d[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < self.k
            near[rows[row[keep]], place[keep]], away[rows[row[keep]], place[keep]] = point[keep], d[keep]
            begin = end


def _broadcast_knn(left: DataFrame, right: DataFrame, k: int, dims: int) -> DataFrame:
    """The right keys, in tiebreak order, are searched on every executor; the right rows are joined by number afterwards."""
    spark = left.sparkSession
    right = checkpointed(right.withColumn("rid", F.monotonically_increasing_id()))
    keys = right.orderBy("t", "rid").select("rid", "q").toArrow()
    if not keys.num_rows:
        return left.join(right, F.lit(False)).withColumn("d", F.lit(0.0))
    ids = keys["rid"].to_numpy()
    points = np.array(keys["q"].combine_chunks().flatten()).reshape(-1, dims)
    shared = spark.sparkContext.broadcast((ids, points))
    schema = left.select("l").schema.add("near", ArrayType(LongType())).add("away", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, there = shared.value
        index = CellIndex(there, k)
        for batch in batches:
            mine = np.array(batch.column(1).flatten()).reshape(-1, dims)
            near, away = index.nearest(mine)
            offsets = pa.array(np.arange(len(mine) + 1, dtype=np.int32) * index.k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(numbers[near].ravel())), pa.ListArray.from_arrays(offsets, pa.array(away.ravel()))], ["l", "near", "away"])

    # All cores should share a small left side, which may be one file.
    cores = spark.sparkContext.defaultParallelism
    left = left.repartition(cores) if _bytes(left) < cores * _FILE_BYTES else left
    found = left.select("l", "p").mapInArrow(run, schema)
    pairs = found.select("l", F.explode(F.arrays_zip("near", "away")).alias("m")).select("l", F.col("m.near").alias("rid"), F.col("m.away").alias("d"))
    return pairs.join(right.hint("merge"), "rid")


def _grid_candidates(left: DataFrame, right: DataFrame, k: int, dims: int) -> DataFrame:
    """Pairs that hold the k nearest right rows of every left place. Both sides are checkpointed."""
    lk, rk = _coords("p", dims), _coords("q", dims)
    ends = right.agg(F.count("*"), *[f(x) for x in rk for f in (F.min, F.max)]).first()
    n = ends[0]
    low, high = ends[1::2], ends[2::2]
    if n <= k:  # as right rows in one place are k at most, more than k rows have an extent
        return left.join(F.broadcast(right), F.lit(True))  # k rows at most
    used = [i for i in range(dims) if high[i] > low[i]][:3]
    width = (math.prod(high[i] - low[i] for i in used) * k / n) ** (1 / len(used)) / 2
    # On the last level a block of cells covers everything.
    levels = list(range(max(1, math.ceil(math.log2(max((high[i] - low[i]) / width for i in used))) + 2)))
    cells, at, beside = ([f"{c}{j}" for j in range(len(used))] for c in "cab")

    def inside(i: int) -> Column:
        return F.greatest(F.lit(low[i]), F.least(F.lit(high[i]), lk[i]))

    def on_level(names: list[str], level: Column, out: list[str]) -> list[Column]:
        return [F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long").alias(x) for c, x in zip(names, out, strict=True)]

    # Left points are moved to the right rows' extent, in the dimensions that have cells.
    left = left.withColumns({c: _cell(inside(i), width) for c, i in zip(cells, used, strict=True)})
    every = F.explode(F.array(*map(F.lit, levels))).alias("level")
    counts = right.groupBy(*[_cell(rk[i], width).alias(c) for c, i in zip(cells, used, strict=True)]).agg(F.count("*").alias("n"))
    sums = counts.select("*", every).groupBy("level", *on_level(cells, F.col("level"), beside)).agg(F.sum("n").alias("n"))
    # Coarser cells are fewer, so those of all levels are about as many as the finest.
    wanted = checkpointed(left.select(*cells).distinct())
    up = wanted.select(*cells, every).select("level", *cells, *on_level(cells, F.col("level"), at))
    around = up.select("level", *at).distinct().withColumn("o", F.explode(_around(len(used))))
    around = around.select("level", *at, *[(F.col(p) + F.col(f"o.o{j}")).alias(q) for j, (p, q) in enumerate(zip(at, beside, strict=True))])
    full = around.join(sums.hint("merge"), ["level", *beside]).groupBy("level", *at).agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    resolved = up.join(full.hint("merge"), ["level", *at]).groupBy(*cells).agg(F.min("level").alias("level"))
    # k right rows lie within two cell widths of the moved point in each such dimension, and within the extent in the others.
    shift = F.sqrt(sum([(lk[i] - inside(i)) * (lk[i] - inside(i)) for i in used], F.lit(0.0)))
    others = [F.greatest(F.abs(lk[i] - low[i]), F.abs(lk[i] - high[i])) for i in range(dims) if i not in used]
    rest = F.sqrt(sum([x * x for x in others], F.lit(0.0)))
    reach = 2 * math.sqrt(len(used)) * width * F.pow(F.lit(2.0), F.col("level"))
    here = left.join(resolved.hint("merge"), cells).withColumn("bound", (reach + shift + rest) * (1 + 1e-9))
    # Cells are at least a third of the bound wide, so a row meets eight of them in a dimension at most.
    here = here.withColumn("level", F.greatest(F.col("level"), F.ceil(F.log2(F.col("bound") / (3 * width))).cast("int")))
    here = checkpointed(here.drop(*cells))
    in_use = [r[0] for r in here.select("level").distinct().collect()]  # as many as levels
    if not in_use:
        return left.drop(*cells).join(right, F.lit(False))
    w = F.lit(width) * F.pow(F.lit(2.0), F.col("level"))
    there = right.withColumn("level", F.explode(F.array(*map(F.lit, in_use))))
    for j, i in enumerate(used):
        first, last = (_cell(F.greatest(F.lit(low[i]), F.least(F.lit(high[i]), x)), w) for x in (lk[i] - F.col("bound"), lk[i] + F.col("bound")))
        here = here.withColumn(f"g{j}", F.explode(F.sequence(first, last)))
        there = there.withColumn(f"g{j}", _cell(rk[i], w))
    return here.join(there.hint("merge"), ["level", *[f"g{j}" for j in range(len(used))]])


def _block_knn(places: DataFrame, points: DataFrame, k: int, dims: int) -> DataFrame:
    """(p, rid, d), from blocks of both sides: each left block is searched for in the right ones that can hold a neighbour of one of its rows."""
    kl, kr = _coords("p", dims), _coords("q", dims)
    z = _z_order([_extent(places, kl), _extent(points, kr)], dims)
    (left, own), (right, other) = _blocked(places, "lb", kl, z), _blocked(points, "rb", kr, z)
    near = _near_blocks(own, other, dims, k=k)
    return _local_knn(left.withColumnRenamed("lb", "g"), right.join(near.hint("merge"), "rb").withColumnRenamed("lb", "g"), k, dims)


def _voronoi_knn(places: DataFrame, points: DataFrame, k: int, dims: int) -> DataFrame:
    """(p, rid, d), by cells around pivots: one for so many rows, so that cells don't grow with the sides."""
    spark = places.sparkSession
    n = max(Config(spark).get("voronoi.pivots"), min(_PIVOTS, math.ceil(max(places.count(), points.count()) / _PIVOT_ROWS)))
    picked = points.select("q").orderBy(F.xxhash64("q"), "q").limit(n).collect()
    pivots = np.array(sorted({tuple(x[0]) for x in picked})).reshape(-1, dims)
    if not len(pivots):
        return _local_knn(places.withColumn("g", F.lit(0).cast("long")), points.withColumn("g", F.lit(0).cast("long")), k, dims)

    def cells(df: DataFrame, name: str, cell: str, off: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = CellIndex(pivots, 1)
            for batch in batches:
                near, away = index.nearest(np.array(batch.column(name).flatten()).reshape(-1, dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.ravel()), pa.array(away.ravel())], [*batch.schema.names, cell, off])

        return checkpointed(df.mapInArrow(run, df.select("*").schema.add(cell, LongType()).add(off, DoubleType())))

    left, right = cells(places, "p", "g", "away"), cells(points, "q", "j", "off")
    widest = {x["g"]: x["u"] for x in left.groupBy("g").agg(F.max("away").alias("u")).collect()}
    order = Window.partitionBy("j").orderBy("off")
    # The k smallest distances from each pivot: pivots x k numbers; and the greatest one.
    closest = right.select("j", "off", F.row_number().over(order).alias("n")).where(F.col("n") <= k).toArrow()
    last = {x["j"]: x["u"] for x in right.groupBy("j").agg(F.max("off").alias("u")).collect()}
    at, least = closest["j"].to_numpy(), closest["off"].to_numpy()
    table = []
    for i, u in widest.items():
        between = np.sqrt(((pivots - pivots[i]) ** 2).sum(axis=1))
        bounds = u + between[at] + least
        bound = np.partition(bounds, k - 1)[k - 1] if k <= len(bounds) else np.inf
        from_here = between - (u + bound) * (1 + 1e-9) - between * 1e-9
        table += [(int(i), int(j), float(from_here[j])) for j in last if last[j] >= from_here[j]]
    reach = spark.createDataFrame(table, "g long, j long, least double")
    sent = right.join(F.broadcast(reach), "j").where(F.col("off") >= F.col("least"))
    return _local_knn(left, sent, k, dims)


def _positions(marks: DataFrame) -> DataFrame:
    """marks (curve, z, kind, id) with `place`: how many of kind 0 stand before, in the order of these. No task sees more than a range."""
    order = ["curve", "z", "kind", "id"]
    parts = checkpointed(marks.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = (1 - F.col("kind")).cast("long")
    totals = parts.groupBy("part").agg(F.sum(own).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.coalesce(F.sum(own).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("upto", upto).join(F.broadcast(before), "part").select(*order, (F.col("upto") + F.col("before")).alias("place"))


def zknn_join(left: DataFrame, right: DataFrame, left_keys: Keys, right_keys: Keys, k: int, tiebreak: list[str] = (), shifts: int | None = None, seed: int = 42, reach: int | None = None, suffixes: tuple[str, str] = ("_l", "_r"), dist_col: str | None = None) -> DataFrame:
    """An approximate kNN join: candidates are the right rows next to each left row on 1 + `shifts` shifted z-curves, `reach` before and as many after (k if it is larger).

    Both sides are sorted along a curve in ranges, each row gets its position among the right rows from its
    range's offset, and candidates come by an equality join on positions. Every left row gets min(k, right rows) matches.
    """
    config = Config(left.sparkSession)
    shifts = config.get("zorder.shifts") if shifts is None else shifts
    reach = max(k, config.get("zorder.reach") if reach is None else reach)
    left, right, a, b = _named(left, right, suffixes)
    lk, rk = _keys(left_keys, a), _keys(right_keys, b)
    out = _out(left, right, dist_col)
    dims = len(lk)
    rows = checkpointed(_packed(left.where(g.known(lk)), "l", p=F.array(*lk)))
    # Left rows in one place have the same candidates, so places are looked up, and not rows.
    left = checkpointed(rows.select("p").distinct().withColumn("id", F.monotonically_increasing_id()))
    right = _packed(right.where(g.known(rk)), "r", q=F.array(*rk), t=F.struct(F.lit(0).alias("_"), *[column(b[t]) for t in tiebreak]))
    right = _numbered(right, k, bool(tiebreak))
    n = right.count()
    if n == 0 or k <= 0:
        return rows.join(right, F.lit(False)).withColumn("d", F.lit(0.0)).select(*out)
    z = _z_order([_extent(df, _coords(c, dims)) for df, c in ((left, "p"), (right, "q"))], dims)
    rng = np.random.default_rng(seed)
    offsets = [[0.0] * dims, *(rng.random(dims).tolist() for _ in range(shifts))]

    def curves(name: str) -> Column:
        """(curve, z) of a point, for every curve."""
        return F.explode(F.array(*[F.struct(F.lit(s).alias("curve"), z(_coords(name, dims), offset).alias("z")) for s, offset in enumerate(offsets)])).alias("c")

    marks = right.select(curves("q"), F.lit(0).alias("kind"), F.col("rid").alias("id")).unionByName(left.select(curves("p"), F.lit(1).alias("kind"), "id"))
    # The n right rows of each curve stand together. At a curve's ends the places beyond are taken from the other side.
    placed = _positions(checkpointed(marks.select("c.curve", "c.z", "kind", "id"))).withColumn("place", F.col("place") - F.col("curve") * n)
    start = F.greatest(F.lit(0), F.least(F.col("place") - reach, F.lit(n - 2 * reach)))
    wanted = placed.where("kind = 1").select("curve", "id", F.explode(F.sequence(start, F.least(start + 2 * reach - 1, F.lit(n - 1)))).alias("place"))
    found = wanted.join(placed.where("kind = 0").select("curve", F.col("id").alias("rid"), "place").hint("merge"), ["curve", "place"]).select("id", "rid")
    pairs = found.distinct().join(left.hint("merge"), "id").join(right.select("rid", "q").hint("merge"), "rid")
    near = _nearest(pairs, k, dims).select("p", "rid", "d")
    return near.join(rows.hint("merge"), "p").join(right.hint("merge"), "rid").select(*out)
