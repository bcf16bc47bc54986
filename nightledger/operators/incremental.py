"""Incremental loads, snapshot merging and coarser roll-ups."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators.ranking import first_per_key
from nightledger.sources.tables import remove

NIGHT = ["listing_id", "calendar_date"]


def split_arrivals(nights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A first delivery of all nights, and a later one that raises 2001 prices by 1."""
    changed = nights.where(F.year("calendar_date") == 2001)
    price = (F.col("price") + F.lit(1)).cast("decimal(10,2)")
    return nights, changed.withColumn("price", price)


def combine_snapshots(snapshots: dict[str, DataFrame]) -> DataFrame:
    """The newest row of each (listing, date) over dated deliveries."""
    dated = [
        df.withColumn("snapshot_date", F.lit(day).cast("date")) for day, df in snapshots.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dated)
    return first_per_key(stacked, NIGHT, [F.desc("snapshot_date")])


def upsert_nights(spark: SparkSession, path: str, arrivals: DataFrame) -> None:
    """Replace or add the arriving nights; only the months they touch are rewritten.

    The arrivals are evaluated once, written beside the table under a name of this run's own.
    The new months are written there too and then swapped in, because a month cannot be
    overwritten while it is being read.
    """
    beside = f"{path}_arriving_{uuid.uuid4().hex}"
    _write_months(arrivals, f"{beside}/nights")
    new = spark.read.schema(arrivals.schema).parquet(f"{beside}/nights")
    months = [r.year_month for r in new.select("year_month").distinct().collect()]
    if months:
        if _exists(spark, path):
            old = spark.read.schema(new.schema).parquet(path).where(F.col("year_month").isin(months))
            kept = old.join(new.select(*NIGHT), NIGHT, "left_anti")
            _write_months(kept.unionByName(new.select(*old.columns)), f"{beside}/months")
            new = spark.read.schema(new.schema).parquet(f"{beside}/months")
        _write_months(new, path, "dynamic")
    remove(spark, beside)


def _write_months(df: DataFrame, path: str, mode: str = "static") -> None:
    (
        df.hint("rebalance", "year_month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy("year_month")
        .parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    # a dynamic overwrite leaves no success marker, so the folder itself is looked for
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def weekly_rollup(nights: DataFrame) -> DataFrame:
    """Nights, bookings and revenue per listing and week, weeks starting on Monday."""
    booked = F.col("is_available") == 0
    week_start = F.date_sub("calendar_date", F.weekday("calendar_date"))
    return nights.groupBy(
        "listing_id", week_start.alias("week_start")
    ).agg(
        F.count(F.lit(1)).alias("nights_tracked"),
        F.count_if(booked).alias("nights_booked"),
        F.sum(F.when(booked, F.col("price")).otherwise(F.lit(0).cast("decimal(10,2)"))).alias(
            "revenue"
        ),
    )
