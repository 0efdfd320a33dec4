"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: White space between words, as a class of ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch to or from a Python worker, and characters after which a leaving batch is closed.
BATCH_ROWS, BATCH_CHARS = 500, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query; if its files give fewer partitions than there are cores, it is dealt out anew."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def quoted(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder for tables under the shared one of spark.checkpoint.dir.

    A folder of its own is set only where the session names none and has no executors elsewhere, as in tests.
    """
    return f"{_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir and cut from its lineage."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Batches of whole texts must be small: lowers the session's Arrow batch size to BATCH_ROWS."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, columns: list[Column], schema: str, make: Callable[[], Callable[..., list[tuple] | tuple | None]], weigh: int = 0) -> DataFrame:
    """Runs a Python function on each row; the batches that come and go are bounded by characters.

    make() is called once per partition and gives a function of the row's values that returns
    one tuple, a list of tuples, or None. weigh: the number of the input column whose length
    counts for closing a batch.
    """
    source = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    arrow = arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for values in zip(*[_values(c) for c in batch.columns], strict=True):
                out = work(*values)
                if out is None:
                    continue
                if isinstance(out, list):
                    rows += out
                else:
                    rows.append(out)
                held += len(values[weigh]) if isinstance(values[weigh], (str, bytes)) else 1
                if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield make_batch(rows, arrow)
                    rows, held = [], 0
        if rows:
            yield make_batch(rows, arrow)

    return source.mapInArrow(run, schema)


def _values(column: pa.Array) -> Iterator:
    """The values one by one: a long text is not held twice for the whole batch."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
        return (x.as_py() for x in column)
    return iter(column.to_pylist())


def arrow_schema(schema: str | StructType) -> pa.Schema:
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])


def make_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

