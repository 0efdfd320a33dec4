"""Tables written to the folder that all executors share, and names that no column has."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of spark.checkpoint.dir. One of its own is set only in local sessions that name none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut from its lineage: rows and the ids given to them stay as they are, whatever executor is lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def column(name: str) -> Column:
    """The column of a name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to differ from the taken ones."""
    known = {c.lower() for c in taken}
    found = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        found.append(name)
    return found
