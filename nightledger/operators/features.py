"""Revenue, occupancy and listing features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.functions.labels import (
    experience_tier,
    price_category,
    pricing_signal,
    pricing_signal_pct,
)
from nightledger.functions.numeric import half_even, ratio
from nightledger.functions.parsing import amenity_count
from nightledger.operators.quantiles import column_quantiles, exact_quantiles
from nightledger.operators.scalars import with_values
from nightledger.schemas import CENTS, MONEY, RATE, SUB_SCORES

# Fixed value: nightly price times this is the invented property value.
VALUE_MULTIPLIER = 250



def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` before they are summed, for groups of few rows each.

    Most listings have a night or two in a month, so sums made before the shuffle are as many
    as the nights and several times as wide. The number of partitions is the session's: left
    to coalesce narrow rows by their bytes, Spark would give a task more groups than it can hold.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def monthly_sums(cal: DataFrame) -> DataFrame:
    """One row per listing and month with additive columns; every KPI rolls up from it."""
    booked, month = ~F.col("available"), F.date_format("date", "yyyy-MM")
    nights = dealt_by(cal.select("listing_id", "date", "available", "price"), "listing_id")
    return nights.groupBy(F.col("listing_id").alias("id"), month.alias("year_month")).agg(
        F.count("date").alias("nights_tracked"),
        F.count_if(booked).alias("nights_booked"),
        F.sum(F.when(booked, F.col("price"))).alias("booked_revenue"),
        F.sum(F.when(booked, F.col("price").cast("decimal(10,2)"))).alias("booked_cents"),
        F.sum(F.when(F.col("available"), F.col("price"))).alias("open_price_sum"),
        F.count(F.when(F.col("available"), F.col("price"))).alias("open_nights"),
        F.min("date").alias("first_night"),
        F.max("date").alias("last_night"),
    )


def occupancy(booked: Column, tracked: Column) -> Column:
    return half_even(ratio(booked, tracked), 4).cast(RATE)


def per_night(revenue: Column, nights: Column) -> Column:
    """Money per night to the cent; 0 when there are no nights."""
    return F.when(nights > 0, half_even(ratio(revenue, nights), 2)).otherwise(0.0).cast(CENTS)


def listing_metrics(monthly: DataFrame) -> DataFrame:
    """Revenue, occupancy, ADR and RevPAR per listing (F01-F05) from the monthly sums."""
    sums = monthly.groupBy("id").agg(
        F.sum("nights_tracked").alias("total_nights_tracked"),
        F.sum("nights_booked").alias("booked_nights"),
        F.min("first_night").alias("calendar_start"),
        F.max("last_night").alias("calendar_end"),
        F.coalesce(F.sum("booked_revenue"), F.lit(0)).cast(MONEY).alias("revenue_estimate"),
        F.sum("open_price_sum").alias("open_price_sum"),
        F.sum("open_nights").alias("open_nights"),
    )
    return kpis(sums)


def night_metrics(cal: DataFrame) -> DataFrame:
    """``listing_metrics`` from the nights themselves, where a listing's nights lie together in the
    files: sums made before the shuffle are then about as many as the listings."""
    booked, price = ~F.col("available"), F.col("price")
    sums = cal.groupBy(F.col("listing_id").alias("id")).agg(
        F.count("date").alias("total_nights_tracked"),
        F.count_if(booked).alias("booked_nights"),
        F.min("date").alias("calendar_start"),
        F.max("date").alias("calendar_end"),
        F.coalesce(F.sum(F.when(booked, price)), F.lit(0)).cast(MONEY).alias("revenue_estimate"),
        F.sum(F.when(F.col("available"), price)).alias("open_price_sum"),
        F.count(F.when(F.col("available"), price)).alias("open_nights"),
    )
    return kpis(sums)


def kpis(sums: DataFrame) -> DataFrame:
    """Occupancy, ADR, RevPAR and the open price of listings whose sums are known."""
    booked, tracked = F.col("booked_nights"), F.col("total_nights_tracked")
    revenue = F.col("revenue_estimate")
    return sums.select(
        "id",
        "total_nights_tracked",
        "booked_nights",
        "calendar_start",
        "calendar_end",
        "revenue_estimate",
        ratio(F.col("open_price_sum"), F.col("open_nights")).alias("avg_open_listing_price"),
        occupancy(booked, tracked).alias("occupancy_rate"),
        per_night(revenue, booked).alias("adr"),
        per_night(revenue, tracked).alias("revpar"),
    )


def monthly_aggregate(monthly: DataFrame) -> DataFrame:
    """Nights, revenue and occupancy per listing and month."""
    return monthly.select(
        "id",
        "year_month",
        "nights_tracked",
        "nights_booked",
        F.coalesce(F.col("booked_revenue"), F.lit(0)).cast(MONEY).alias("revenue"),
        occupancy(F.col("nights_booked"), F.col("nights_tracked")).alias("occupancy_rate"),
    )


def experience_years(host_since: Column, as_of: str) -> Column:
    days = F.datediff(F.lit(as_of).cast("date"), host_since)
    return half_even(days / F.lit(365.25), 1)


def market_values(listings: DataFrame, as_of: str) -> DataFrame:
    """One row with the median experience and the price quartiles, found in one pass."""
    columns, wanted = [], {}
    if "host_since" in listings.columns:
        columns.append(experience_years(F.col("host_since"), as_of).alias("years"))
        wanted["_median"] = ("years", 0.5)
    if "price" in listings.columns:
        columns.append(F.col("price"))
        wanted |= {"_q1": ("price", 0.25), "_q2": ("price", 0.5), "_q3": ("price", 0.75)}
    values = column_quantiles(listings.select(*columns), wanted)
    edges = [c for c in values.columns if c.startswith("_q")]
    return values.withColumns({c: F.col(c).cast(MONEY) for c in edges})


def host_experience(df: DataFrame, as_of: str, values: DataFrame | None = None) -> DataFrame:
    """Years as a host, gaps filled with the market median, and the tier.

    ``values`` is the result of ``market_values``, taken from ``df`` when not given.
    """
    values = market_values(df.select("host_since"), as_of) if values is None else values
    years = experience_years(F.col("host_since"), as_of)
    return (
        with_values(df, values)
        .withColumn("host_experience_years", F.coalesce(years, "_median", F.lit(0.0)))
        .withColumn("host_experience_tier", experience_tier(F.col("host_experience_years")))
        .drop(*values.columns)
    )


def price_categories(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Quartile band of the price over the whole market."""
    values = market_values(df.select("price"), "") if values is None else values
    band = price_category(F.col("price"), F.col("_q1"), F.col("_q2"), F.col("_q3"))
    return with_values(df, values).withColumn("price_category", band).drop(*values.columns)


def stale_flag(days: Column, never_reviewed_is_stale: bool = False) -> Column:
    """More than 365 days since the last review."""
    return F.coalesce(days > 365, F.lit(never_reviewed_is_stale))


def recency(df: DataFrame, as_of: str, never_reviewed_is_stale: bool = False) -> DataFrame:
    """Listing age, days since the last review and the stale flag."""
    today = F.lit(as_of).cast("date")
    columns = {}
    if "first_review" in df.columns:
        columns["listing_age_days"] = F.datediff(today, F.col("first_review"))
    if "last_review" in df.columns:
        days = F.datediff(today, F.col("last_review"))
        columns["days_since_last_review"] = days
        columns["is_stale_listing"] = stale_flag(days, never_reviewed_is_stale)
    return df.withColumns(columns) if columns else df


def composite_score(scores: list[Column]) -> Column:
    """Mean of the scores that are present, to 2 places."""
    total, known = F.lit(0.0), F.lit(0)
    for c in scores:
        total = total + F.coalesce(c, F.lit(0.0))
        known = known + F.when(c.isNull(), 0).otherwise(1)
    return F.when(known > 0, half_even(total / known, 2)).cast("decimal(3,2)")


def listing_features(
    listings: DataFrame, as_of: str, never_reviewed_is_stale: bool = False
) -> DataFrame:
    df, values = listings, market_values(listings, as_of)
    if "host_since" in df.columns:
        df = host_experience(df, as_of, values)
    else:
        df = df.withColumns(
            {
                "host_experience_years": F.lit(None).cast("double"),
                "host_experience_tier": F.lit(None).cast("string"),
            }
        )
    df = price_categories(df, values).transform(recency, as_of, never_reviewed_is_stale)
    present = [F.col(c) for c in SUB_SCORES if c in df.columns]
    if present:
        df = df.withColumn("review_score_composite", composite_score(present))
    if "amenities" in df.columns:
        df = df.withColumn("amenity_count", amenity_count(F.col("amenities")))
    return df


def price_per_bedroom(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Median price per bedroom of the listing's neighbourhood, or of the market."""
    name = "neighbourhood_median_price_per_bedroom"
    rooms = F.coalesce(F.col("bedrooms"), F.lit(1.0))
    rooms = F.when(rooms < 1, 1.0).otherwise(rooms)
    source = df if source is None else source
    per_room = source.withColumn("_per_room", ratio(F.col("price"), rooms))
    df = df.withColumn("bedrooms_for_valuation", rooms)
    if "neighbourhood_cleansed" in df.columns:
        by = ["neighbourhood_cleansed"]
        medians = exact_quantiles(per_room, "_per_room", {name: 0.5}, by=by)
        return df.join(medians.withColumn(name, F.col(name).cast(MONEY)), by, "left")
    median = column_quantiles(per_room, {name: ("_per_room", 0.5)})
    return with_values(df, median.select(F.col(name).cast(MONEY)))


def property_value(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """SYNTHETIC value = median price per bedroom x bedrooms x 250, with its flag."""
    df = price_per_bedroom(df, source)
    value = (
        F.col("neighbourhood_median_price_per_bedroom")
        * F.col("bedrooms_for_valuation").cast("decimal(6,1)")
        * F.lit(VALUE_MULTIPLIER)
    )
    return df.withColumns(
        {
            "estimated_property_value": F.bround(value, 0).cast("decimal(18,2)"),
            "is_synthetic_valuation": F.lit(True),
        }
    )


def master_table(features: DataFrame, metrics: DataFrame) -> DataFrame:
    """Listings with their calendar metrics, ROI, pricing gap and signal."""
    df = features.join(metrics, "id", "left")
    value, revenue = F.col("estimated_property_value"), F.col("revenue_estimate")
    gap = half_even(F.col("price") - F.col("adr"), 2).cast(CENTS)
    roi = F.when(value > 0, half_even(ratio(revenue, value) * 100, 2)).cast(CENTS)
    return (
        df.withColumn("estimated_annual_roi_pct", roi)
        .withColumn("pricing_gap", gap)
        .withColumn("pricing_signal", pricing_signal(F.col("pricing_gap")))
    )


def percentage_signal(master: DataFrame, threshold: float = 0.2) -> DataFrame:
    """The pricing signal judged relative to the base price."""
    return master.withColumn(
        "pricing_signal_pct", pricing_signal_pct(F.col("pricing_gap"), F.col("price"), threshold)
    )
