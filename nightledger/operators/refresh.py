"""Deliveries of nights that carry their changes on to the monthly sums, the listing metrics
and the monthly star fact (X01).

A night that arrives replaces the one with its (listing, date) or is added; none is ever
removed. Its change is a signed delta: plus its own values, minus those of the night it
replaces. Deltas are summed per listing and month and merged into the stored sums, so a
delivery reads the nights and sums of its own months, and the totals of its own listings'
buckets, and nothing else. Money is decimal, so merged sums equal a full rebuild to the cent.

Every partition (a month, or a bucket of listings) is written once, under the number of the
delivery that changed it. The last thing written is a small table that says which number holds
for each partition. A delivery that dies before that has changed nothing, and is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators import features, star
from nightledger.operators.incremental import NIGHT
from nightledger.session import shared_dir
from nightledger.sources.tables import remove

#: Sums that deltas change, and how: decimals keep the width that Spark gives sums of prices.
AMOUNT = "decimal(20,2)"
COUNTS = ["nights_tracked", "nights_booked", "booked_priced", "open_nights"]
AMOUNTS = ["booked_revenue", "open_price_sum"]
EDGES = ["first_night", "last_night"]
PARTITION = {"nights": "year_month", "monthly": "year_month", "totals": "bucket", "fact_monthly": "year_month"}


def signed_sums(arriving: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """One delta per listing and month: what arrives counts plus, what it replaces minus."""
    both = arriving.withColumn("sign", F.lit(1))
    if replaced is not None:
        both = both.unionByName(replaced.withColumn("sign", F.lit(-1)))
    booked, priced = F.col("is_available") == 0, F.col("price").isNotNull()

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("sign")).otherwise(0)).cast("bigint")

    def amount(condition: Column) -> Column:
        signed = F.when(F.col("sign") > 0, F.col("price")).otherwise(-F.col("price"))
        return F.sum(F.when(condition & priced, signed).otherwise(F.lit(0))).cast(AMOUNT)

    # dates never go, so only arriving ones can move the first and last night
    arrives = F.when(F.col("sign") > 0, F.col("calendar_date"))
    return features.dealt_by(both, "listing_id").groupBy("listing_id", "year_month").agg(
        count(F.lit(True)).alias("nights_tracked"),
        count(booked).alias("nights_booked"),
        count(booked & priced).alias("booked_priced"),
        count(~booked & priced).alias("open_nights"),
        amount(booked).alias("booked_revenue"),
        amount(~booked).alias("open_price_sum"),
        F.min(arrives).alias("first_night"),
        F.max(arrives).alias("last_night"),
    )


def merged(stored: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sums plus deltas; both have a row per key at most."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTS]
    sums += [F.sum(c).cast(AMOUNT).alias(c) for c in AMOUNTS]
    return stored.unionByName(delta).groupBy(*keys).agg(
        *sums, F.min("first_night").alias("first_night"), F.max("last_night").alias("last_night")
    )


def _known(amount: str, count: str) -> Column:
    """A sum over no rows is NULL."""
    return F.when(F.col(count) > 0, F.col(amount)).alias(amount)


def _held(state: list, table: str, parts: list[str] | None = None) -> list:
    """The rows of a state that say where a table's partitions lie."""
    return [r for r in state if r["part_of"] == table and (parts is None or r["part"] in set(parts))]


class CalendarStore:
    """``listings`` has the keys that the star fact carries; ``buckets`` divides the listings
    and stays the same for the life of a store."""

    def __init__(self, spark: SparkSession, path: str, listings: DataFrame, buckets: int = 64):
        shared_dir(spark)  # deltas are checkpointed
        self.spark, self.path, self.keys, self.buckets = spark, path, listings, buckets
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def deliver(self, nights: DataFrame, delivery: str) -> bool:
        """Load one delivery: (listing_id, calendar_date, is_available, price), a row per key.

        False if this delivery was loaded before. Nights without a listing or date have no key
        and are left out.
        """
        number, state = self._state()
        if any(r["part_of"] == "delivery" and r["part"] == delivery for r in state):
            return False
        number += 1
        month = F.date_format("calendar_date", "yyyy-MM")
        beside = f"{self.path}/arriving/{number}"
        keyed = nights.dropna(subset=NIGHT).select(*NIGHT, "is_available", F.col("price").cast("decimal(10,2)").alias("price"))
        keyed.withColumn("year_month", month).write.mode("overwrite").parquet(beside)
        new = self.spark.read.parquet(beside)
        months = [r.year_month for r in new.select("year_month").distinct().collect()]
        # months that are new have nothing to replace, keep or add to
        known = [m for m in months if _held(state, "nights", [m])]
        nights = new
        if known:
            old = self._read("nights", new.schema, state, known)
            again = new.where(F.col("year_month").isin(known)).select(*NIGHT)
            delta = signed_sums(new, old.join(again, NIGHT, "left_semi")).checkpoint()
            kept = old.join(again, NIGHT, "left_anti")
            nights = kept.unionByName(new.select(*kept.columns))
        else:
            delta = signed_sums(new).checkpoint()
        written = self._write("nights", nights, number)

        monthly = delta
        if known:
            monthly = merged(self._read("monthly", delta.schema, state, known), delta, ["listing_id", "year_month"])
        written += self._write("monthly", monthly, number)
        touched = self._read("monthly", delta.schema, written, months)
        written += self._write("fact_monthly", star.fact_calendar_monthly(self._shaped(touched), self.keys).withColumnRenamed("YearMonth", "year_month"), number)

        bucket = F.pmod(F.hash("listing_id"), F.lit(self.buckets)).cast("string")
        by_listing = delta.drop("year_month").withColumn("bucket", bucket)
        buckets = [r.bucket for r in by_listing.select("bucket").distinct().collect()]
        totals = self._read("totals", by_listing.schema, state, buckets)
        written += self._write("totals", merged(totals, by_listing, ["listing_id", "bucket"]), number)
        self._commit(number, state, [*written, {"part_of": "delivery", "part": delivery, "number": number}])
        remove(self.spark, beside)
        return True

    def nights(self) -> DataFrame:
        return self._all("nights")

    def monthly(self) -> DataFrame:
        """With the columns of ``features.monthly_sums``."""
        return self._shaped(self._all("monthly"))

    def metrics(self) -> DataFrame:
        """F01-F05 from the listings' totals."""
        totals = self._all("totals").select(
            F.col("listing_id").alias("id"),
            F.col("nights_tracked").alias("total_nights_tracked"),
            F.col("nights_booked").alias("booked_nights"),
            F.col("first_night").alias("calendar_start"),
            F.col("last_night").alias("calendar_end"),
            F.col("booked_revenue").cast(features.MONEY).alias("revenue_estimate"),
            _known("open_price_sum", "open_nights"),
            "open_nights",
        )
        return features.kpis(totals)

    def fact_monthly(self) -> DataFrame:
        """FactCalendarMonthly."""
        return self._all("fact_monthly").withColumnRenamed("year_month", "YearMonth")

    @staticmethod
    def _shaped(monthly: DataFrame) -> DataFrame:
        return monthly.select(
            F.col("listing_id").alias("id"),
            "year_month",
            "nights_tracked",
            "nights_booked",
            _known("booked_revenue", "booked_priced"),
            _known("booked_revenue", "booked_priced").alias("booked_cents"),
            _known("open_price_sum", "open_nights"),
            "open_nights",
            *EDGES,
        )

    # -- partitions and the table that says which of them hold ---------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _state(self) -> tuple[int, list]:
        """Number of the last delivery and a row per partition; a few thousand for decades of months."""
        folder = self._at("states")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        numbers = [int(f.getPath().getName()) for f in found]
        done = [n for n in numbers if self._fs.exists(self._at(f"states/{n}/_SUCCESS"))]
        if not done:
            return 0, []
        last = max(done)
        return last, self.spark.read.parquet(f"{self.path}/states/{last}").collect()

    def _commit(self, number: int, state: list, written: list) -> None:
        held = {(r["part_of"], r["part"]): r["number"] for r in [*state, *written]}
        rows = [(t, p, n) for (t, p), n in sorted(held.items())]
        df = self.spark.createDataFrame(rows, "part_of string, part string, number bigint")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/states/{number}")

    def _write(self, table: str, df: DataFrame, number: int) -> list[dict]:
        by = PARTITION[table]
        path = f"{self.path}/{table}/number={number}"
        df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)
        there = self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(path))
        parts = [f.getPath().getName().split("=", 1)[1] for f in there if "=" in f.getPath().getName()]
        return [{"part_of": table, "part": p, "number": number} for p in parts]

    def _read(self, table: str, schema, state: list, parts: list[str] | None = None) -> DataFrame:
        by = PARTITION[table]
        rows = _held(state, table, parts)
        if not rows:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{table}/number={r['number']}/{by}={r['part']}" for r in rows]
        reader = self.spark.read.option("basePath", f"{self.path}/{table}")
        return (reader.schema(schema) if schema else reader).parquet(*paths).drop("number")

    def _all(self, table: str) -> DataFrame:
        _, state = self._state()
        held = next((r for r in state if r["part_of"] == table), None)
        if held is None:
            raise ValueError(f"nothing was delivered to {self.path}")
        by = PARTITION[table]
        sample = self.spark.read.parquet(f"{self.path}/{table}/number={held['number']}/{by}={held['part']}")
        return self._read(table, sample.schema.add(by, "string"), state)
