"""Cutting lineage through the folder that the session names in spark.checkpoint.dir.

Everything written here lies in a shared folder, so it outlives a lost executor. Only a
session without the setting, as in tests, gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


#: Narrow rows that make up a partition at least, when a checkpoint is read.
PARTITION_ROWS = 50_000


def parts_of(df: DataFrame) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """For narrow rows: an eager checkpoint, removed by Spark when nothing refers to it.

    It is read in as many partitions as its rows need, so that small tables in a loop don't
    leave a file for every partition of every shuffle. ``parts``, where the caller knows how
    many rows to expect, makes the last step run and write in no more partitions.
    """
    root(df.sparkSession)
    held = (df.coalesce(parts) if parts else df).checkpoint()
    return held.coalesce(max(1, -(-held.count() // PARTITION_ROWS)))


def stage(df: DataFrame) -> DataFrame:
    """For wide rows: a compressed table under the shared folder, read back."""
    spark = df.sparkSession
    path = f"{root(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
