"""Typed Parquet stages and database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_stage(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    counts: dict[str, Column] | None = None,
    rebalanced: bool = False,
) -> dict[str, int]:
    """Overwrite a stage (S05); the result has ``counts``, taken from the rows as they are written.

    A partitioned stage is rebalanced on its partition column first, unless it is already: this
    keeps the number of files low and lets the engine split a partition that holds most rows.
    """
    if partition_by and not rebalanced:
        df = df.hint("rebalance", partition_by)
    # after the shuffle, so that only the tasks that write count
    seen = Observation() if counts else None
    if seen:
        df = df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return {name: seen.get[f"c{i}"] for i, name in enumerate(counts)} if seen else {}


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a written stage with its types."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header, doubled quotes, empty text for NULL: what ``read_csv`` expects."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', dateFormat="yyyy-MM-dd")


def read_database(
    spark: SparkSession,
    table: str,
    url: str | None = None,
    split_on: str | None = None,
    splits: int = 1,
    **options: str,
) -> DataFrame:
    """A catalog table, or a JDBC table when ``url`` is given.

    ``split_on`` names a numeric column by whose range the JDBC read is divided.
    """
    if url is None:
        return spark.table(table)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_on:
        edges = f"(select min({split_on}) lo, max({split_on}) hi from {table}) edges"
        bounds = spark.read.format("jdbc").options(url=url, dbtable=edges, **options)
        lo, hi = bounds.select(F.col("lo").cast("bigint"), F.col("hi").cast("bigint")).first()
        if lo is not None:
            reader = reader.options(
                partitionColumn=split_on, lowerBound=lo, upperBound=hi, numPartitions=splits
            )
    return reader.load()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
