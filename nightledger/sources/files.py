"""Raw CSV files and load-ready CSV tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.functions.parsing import rejected
from nightledger.schemas import REJECTED, ROW, TABLES
from nightledger.sources.tables import write_csv


def located(df: DataFrame) -> DataFrame:
    """Rows read from files with their place in them.

    A split's rows are read in order by one task, so the task's own numbering orders them;
    path and start of the split order the splits. The value is unique and can be repeated:
    reading the same files again gives the same order.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    )
    return df.select("*", place.alias(ROW))


def read_raw_csv(
    spark: SparkSession, path: str, multiline: bool = True, locate: bool = False
) -> DataFrame:
    """All columns as text, found by header name (S01); ``locate`` adds each row's place.

    A file whose text holds line breaks cannot be split, so ``multiline`` files should
    arrive as many parts; the calendar holds no free text and is read without it.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=multiline, escape='"', enforceSchema=False
    )
    return located(raw) if locate else raw


def load_table(spark: SparkSession, path: str, table: str, trace: bool = False) -> DataFrame:
    """One load-ready CSV: empty text is NULL, types by column name.

    ``trace`` adds the cells that their type can't hold, with the row's place, to the same rows.
    """
    raw = read_raw_csv(spark, path, multiline=table == "reviews", locate=trace)
    typed = {
        c: F.nullif(F.col(c), F.lit("")).try_cast(kind) if c in raw.columns else F.lit(None).cast(kind)
        for c, kind in TABLES[table].items()
    }
    columns = [value.alias(c) for c, value in typed.items()]
    if not trace:
        return raw.select(*columns)
    bad = {c: rejected(F.col(c), value) for c, value in typed.items() if c in raw.columns}
    cells = [F.when(t.isNotNull(), F.struct(F.lit(c).alias("column"), t.alias("text"))) for c, t in bad.items()]
    listed = F.array_compact(F.array(*cells))
    held = F.when(F.size(listed) > 0, F.struct(F.col(ROW).alias("row"), listed.alias("cells")))
    return raw.select(*columns, held.alias(REJECTED))


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        write_csv(df, os.path.join(folder, name))


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: load_table(spark, os.path.join(folder, t), t) for t in TABLES}
