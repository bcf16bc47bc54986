"""Star schema over the eight tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.labels import PRICE_CATEGORIES, sort_position
from nightledger.operators.audit import orphans

Tables = dict[str, DataFrame]


def dim_date(night_range: DataFrame, padding: int = 7) -> DataFrame:
    """One row per day from ``padding`` days before the first night to after the last.

    ``night_range`` has one row: first_night, last_night.
    """
    days = night_range.where(F.col("first_night").isNotNull()).select(
        F.explode(
            F.sequence(F.date_sub("first_night", padding), F.date_add("last_night", padding))
        ).alias("Date")
    )
    d = F.col("Date")
    return days.select(
        F.date_format(d, "yyyyMMdd").alias("DateKey"),
        "Date",
        F.year(d).alias("Year"),
        F.quarter(d).alias("Quarter"),
        F.month(d).alias("MonthNum"),
        F.date_format(d, "MMMM").alias("MonthName"),
        F.date_format(d, "yyyy-MM").alias("YearMonth"),
        F.date_format(d, "EEEE").alias("DayName"),
        (F.weekday(d) >= 5).alias("IsWeekend"),
    )


def dim_neighbourhood(neighbourhoods: DataFrame) -> DataFrame:
    """D02."""
    return neighbourhoods.withColumnsRenamed(
        {
            "neighbourhood_id": "NeighbourhoodKey",
            "neighbourhood_name": "NeighbourhoodName",
            "neighbourhood_group": "NeighbourhoodGroup",
        }
    )


def dim_host(hosts: DataFrame) -> DataFrame:
    """D03."""
    return hosts.drop("response_time", "identity_verified").withColumnsRenamed(
        {
            "host_id": "HostKey",
            "host_since": "HostSince",
            "is_superhost": "IsSuperhost",
            "response_rate_pct": "ResponseRatePct",
            "total_listings_count": "TotalListingsCount",
            "experience_years": "ExperienceYears",
            "experience_tier": "ExperienceTier",
        }
    )


def dim_listing(listings: DataFrame) -> DataFrame:
    """D04."""
    return (
        listings.drop("host_id", "neighbourhood_id")
        .withColumnsRenamed(
            {
                "listing_id": "ListingKey",
                "property_type": "PropertyType",
                "room_type": "RoomType",
                "accommodates": "Accommodates",
                "bedrooms": "Bedrooms",
                "beds": "Beds",
                "bathrooms": "Bathrooms",
                "amenity_count": "AmenityCount",
                "base_price": "BasePrice",
                "price_category": "PriceCategory",
                "minimum_nights": "MinimumNights",
                "maximum_nights": "MaximumNights",
                "instant_bookable": "InstantBookable",
                "first_review_date": "FirstReviewDate",
                "last_review_date": "LastReviewDate",
                "is_stale_listing": "IsStaleListing",
            }
        )
        .withColumn(
            "PriceCategorySort",
            sort_position(F.col("PriceCategory"), PRICE_CATEGORIES).cast("int"),
        )
    )


def _with_keys(fact: DataFrame, listings: DataFrame) -> DataFrame:
    keys = listings.select(
        "listing_id",
        F.col("host_id").alias("HostKey"),
        F.col("neighbourhood_id").alias("NeighbourhoodKey"),
    )
    return fact.join(keys, "listing_id", "left")


def fact_performance(performance: DataFrame, valuation: DataFrame, listings: DataFrame):
    """Performance with its valuation and the host and neighbourhood keys."""
    value = valuation.select(
        "listing_id",
        F.col("estimated_property_value").alias("EstimatedPropertyValue"),
        F.col("estimated_annual_roi_pct").alias("EstimatedAnnualROIPct"),
        F.col("is_synthetic_valuation").alias("IsSyntheticValuation"),
    )
    return _with_keys(performance.join(value, "listing_id", "left"), listings).withColumnsRenamed(
        {
            "listing_id": "ListingKey",
            "total_nights_tracked": "TotalNightsTracked",
            "booked_nights": "BookedNights",
            "occupancy_rate": "OccupancyRate",
            "revenue_estimate": "RevenueEstimate",
            "adr": "ADR",
            "revpar": "RevPAR",
            "avg_open_listing_price": "AvgOpenListingPrice",
            "pricing_gap": "PricingGap",
            "pricing_signal": "PricingSignal",
        }
    )


def fact_calendar(calendar_daily: DataFrame, listings: DataFrame) -> DataFrame:
    """Nights with keys, IsBooked and BookedRevenue.

    YearMonth is the column the written fact is partitioned by: nights are rebalanced by month
    before the columns that follow from others are added.
    """
    booked = F.col("IsAvailable") == 0
    keyed = _with_keys(calendar_daily, listings).withColumn("_month", F.trunc("calendar_date", "month"))
    return (
        keyed.hint("rebalance", "_month")
        .drop("_month")
        .withColumnsRenamed(
            {
                "listing_id": "ListingKey",
                "calendar_date": "Date",
                "is_available": "IsAvailable",
                "price": "Price",
            }
        )
        .withColumns(
            {
                "DateKey": F.date_format("Date", "yyyyMMdd"),
                "YearMonth": F.date_format("Date", "yyyy-MM"),
                "IsBooked": F.when(booked, 1).otherwise(0),
                "BookedRevenue": F.when(booked, F.col("Price")).otherwise(
                    F.lit(0).cast("decimal(10,2)")
                ),
            }
        )
    )


def fact_calendar_monthly(monthly: DataFrame, listings: DataFrame) -> DataFrame:
    """The calendar fact summed per listing and month, made from the monthly sums.

    The keys are joined to the sums, so the nights themselves are not shuffled for it.
    Its columns are additive.
    """
    sums = monthly.select(
        F.col("id").alias("listing_id"),
        F.col("year_month").alias("YearMonth"),
        F.coalesce("booked_cents", F.lit(0).cast("decimal(10,2)")).alias("BookedRevenue"),
        F.col("nights_booked").alias("IsBooked"),
        F.col("nights_tracked").alias("Nights"),
    )
    return _with_keys(sums, listings).withColumnRenamed("listing_id", "ListingKey")


def fact_reviews(reviews: DataFrame, listings: DataFrame) -> DataFrame:
    """Reviews without their text, with a date key and a count of 1."""
    return (
        _with_keys(reviews.drop("reviewer_id", "reviewer_name", "comments"), listings)
        .withColumnsRenamed(
            {"review_id": "ReviewKey", "listing_id": "ListingKey", "review_date": "ReviewDate"}
        )
        .withColumns(
            {
                "ReviewDateKey": F.date_format("ReviewDate", "yyyyMMdd"),
                "ReviewCount": F.lit(1),
            }
        )
    )


def fact_review_scores(scores: DataFrame, listings: DataFrame) -> DataFrame:
    """D08."""
    return _with_keys(scores, listings).withColumnsRenamed(
        {
            "listing_id": "ListingKey",
            "rating": "Rating",
            "cleanliness": "Cleanliness",
            "checkin": "Checkin",
            "communication": "Communication",
            "location_score": "LocationScore",
            "value_score": "ValueScore",
            "composite_score": "CompositeScore",
        }
    )


# Fixed values: (dimension, key, fact, key in the fact), one to many.
RELATIONSHIPS = [
    ("DimDate", "DateKey", "FactCalendarDaily", "DateKey"),
    ("DimDate", "DateKey", "FactReviews", "ReviewDateKey"),
    ("DimListing", "ListingKey", "FactCalendarDaily", "ListingKey"),
    ("DimListing", "ListingKey", "FactListingPerformance", "ListingKey"),
    ("DimListing", "ListingKey", "FactReviews", "ListingKey"),
    ("DimHost", "HostKey", "FactCalendarDaily", "HostKey"),
    ("DimHost", "HostKey", "FactListingPerformance", "HostKey"),
    ("DimHost", "HostKey", "FactReviews", "HostKey"),
    ("DimNeighbourhood", "NeighbourhoodKey", "FactCalendarDaily", "NeighbourhoodKey"),
    ("DimNeighbourhood", "NeighbourhoodKey", "FactListingPerformance", "NeighbourhoodKey"),
    ("DimNeighbourhood", "NeighbourhoodKey", "FactReviews", "NeighbourhoodKey"),
    ("DimListing", "ListingKey", "FactReviewScores", "ListingKey"),
    ("DimHost", "HostKey", "FactReviewScores", "HostKey"),
    ("DimNeighbourhood", "NeighbourhoodKey", "FactReviewScores", "NeighbourhoodKey"),
]


def star_integrity(star: Tables) -> DataFrame:
    """Fact rows whose key has no dimension row, per relationship."""
    return orphans(
        [
            (fact, f"{fact_key} in {dim}", star[fact], fact_key, dim, star[dim], key)
            for dim, key, fact, fact_key in RELATIONSHIPS
        ]
    )
