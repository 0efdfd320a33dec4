"""Spatial operators on streams.

Range and circle filters and the distance join with a static side are row by row, so the batch
operators work on a stream as they are. Nearest neighbours need a state: `running_knn` keeps the
k nearest rows of all batches so far, in a table of k rows. `windowed_counts` counts by grid cell
and time window with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.operators import filters, joins

range_query, circle_range = filters.range_query, filters.circle_range


def distance_join_static(stream: DataFrame, static: DataFrame, stream_keys: list[str], static_keys: list[str], r: float, suffixes: tuple[str, str] = ("_l", "_r"), dist_col: str | None = None) -> DataFrame:
    """Pairs of stream and static rows at distance r or less, in append mode; the grid join, stateless."""
    return joins.distance_join(stream, static, stream_keys, static_keys, r, "grid", suffixes, dist_col)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: float, window: str, late: str, slide: str | None = None) -> DataFrame:
    """Rows by time window (tumbling, or sliding) and grid cell; rows later than `late` are dropped."""
    cells = [F.floor(F.col(k) / width).cast("long").alias(f"cell_{k}") for k in keys]
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window, slide or window), *cells).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, user: str, gap: str, late: str) -> DataFrame:
    """Session windows of each user's rows."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))


def running_knn(stream: DataFrame, keys: list[str], target: list[float], k: int, path: str, checkpoint: str, tiebreak: list[str] = (), done: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the k nearest rows of all batches under `path`, in a folder per batch; done(rows, batch) is called after each.

    A batch that is run again after a failure overwrites its own folder from that of the batch before.
    """

    def update(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/{number - 1}").unionByName(batch)
        filters.knn(rows, keys, target, k, tiebreak).write.mode("overwrite").parquet(f"{path}/{number}")
        if done:
            done(batch.sparkSession.read.parquet(f"{path}/{number}"), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(update).start()
