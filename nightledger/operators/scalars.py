"""Market-wide values as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_values(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row.

    The frame is a scalar subquery: it runs once, Spark refuses it when it has a second
    row, and no join is needed. An empty frame gives NULLs.
    """
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    unpacked = [F.col("_values")[c].alias(c) for c in one_row.columns]
    return df.withColumn("_values", packed).select(*df.columns, *unpacked)
