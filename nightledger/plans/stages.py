"""Each source, cleaning, feature, table, audit and star operator as a named query."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions import parsing
from nightledger.operators import audit, clean, features, incremental, normalize, star
from nightledger.operators.refresh import CalendarStore
from nightledger.plans import library
from nightledger.schemas import LISTING_COLUMNS, MEDIAN_FILLED, REJECTED, TEXT
from nightledger.sources import files, tables

KEY = ["id", "copy"]


def _raw(w, *columns) -> DataFrame:
    return w["raw_listings"].select(F.col("id").cast("bigint").alias("id"), "copy", *columns)


def _typed(w) -> DataFrame:
    return w["listings_typed"]


def _folder(w, name: str) -> str:
    return os.path.join(w.root, f"{name}-{uuid.uuid4().hex}")


def _digested(w, reviews: DataFrame) -> DataFrame:
    """Whole texts are compared by digest and length; of a text that reviews share both are found once."""
    text = parsing.strip_breaks(F.col("comments")) if TEXT in reviews.columns else F.col("comments")
    found = w.quoted(reviews, short=True, comments_md5=F.md5(F.encode(text, "UTF-8")), comments_length=F.length(text))
    return found.drop("comments")


# -- sources and sinks --------------------------------------------------------------


def s01_read_csv(w) -> DataFrame:
    path = _folder(w, "listings_csv")
    tables.write_csv(w["raw_listings"].drop(REJECTED), path)
    raw = files.read_raw_csv(w.spark, path)
    return raw.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("copy").cast("bigint").alias("copy"),
        "price",
        "amenities",
        "bathrooms_text",
        "host_response_rate",
        "neighbourhood_cleansed",
        "room_type",
    )


def s02_keep_columns(w) -> DataFrame:
    kept, missing = clean.keep_present(w["raw_listings"], list(LISTING_COLUMNS))
    return kept.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(kept.columns)).alias("columns_kept"),
        F.lit(", ".join(missing)).alias("columns_missing"),
    )


def s03_required_columns(w) -> DataFrame:
    cal = clean.require_columns(w["raw_calendar"], ["listing_id", "date", "available"], "calendar")
    return cal.groupBy("available").agg(F.count(F.lit(1)).alias("nights"))


def s04_typed_reread(w) -> DataFrame:
    return w["master"].select(
        "id", "host_since", "first_review", "last_review", "host_is_superhost", "is_stale_listing"
    )


def s05_written_outputs(w) -> DataFrame:
    path = _folder(w, "monthly")
    tables.write_stage(w["monthly_agg"], path, "year_month")
    back = tables.read_stage(w.spark, path, w["monthly_agg"].schema)
    return back.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("listings"), F.sum("revenue").alias("revenue")
    )


def s06_load_csv(w) -> DataFrame:
    path = _folder(w, "listings_load")
    tables.write_csv(w["listings"], path)
    return files.load_table(w.spark, path, "listings")


def s07_load_counts(w) -> DataFrame:
    return audit.row_counts(w.audited(), w.counts())


def s08_read_table(w) -> DataFrame:
    w["neighbourhoods"].createOrReplaceTempView("nightledger_neighbourhoods")
    return tables.read_database(w.spark, "nightledger_neighbourhoods").transform(
        star.dim_neighbourhood
    )


# -- cleaning -----------------------------------------------------------------------


def c01_parse_price(w):
    return _raw(w, parsing.parse_price(F.col("price")).alias("price"))


def c02_parse_percent(w):
    return _raw(w, parsing.parse_percent(F.col("host_response_rate")).alias("host_response_rate"))


def c03_parse_dates(w):
    names = ["host_since", "first_review", "last_review"]
    return _raw(w, *[parsing.parse_date(F.col(c)).alias(c) for c in names])


def c03_rejected_cells(w):
    """Texts that their column's type can't hold."""
    return w.rejected().groupBy("table_name", "column", "text").agg(F.count(F.lit(1)).alias("n"))


def c04_parse_flags(w):
    names = ["host_is_superhost", "host_identity_verified", "instant_bookable"]
    return _raw(w, *[parsing.parse_flag(F.col(c)).alias(c) for c in names])


def c05_bathrooms_from_text(w):
    return _raw(w, parsing.first_number(F.col("bathrooms_text")).alias("bathrooms"))


def c06_fill_medians(w):
    return clean.fill_medians(_typed(w), MEDIAN_FILLED).select(*KEY, *MEDIAN_FILLED)


def c07_flag_response_rate(w):
    filled = clean.flag_and_fill(_typed(w), "host_response_rate")
    return filled.select(*KEY, "host_response_rate", "host_response_rate_missing")


def c08_fill_superhost(w):
    return clean.fill_false(_typed(w), "host_is_superhost").select(*KEY, "host_is_superhost")


def c09_drop_missing(w):
    return _typed(w).dropna(subset=["price"]).select(*KEY, "price")


def c10_dedupe(w):
    return clean.surviving_listings(_typed(w), ["copy"]).select(*KEY, "host_id", "price")


def c11_cap_price(w):
    kept = clean.surviving_listings(_typed(w).select("id", "copy", "price"), ["copy"])
    return clean.cap_iqr(kept, "price").select("id", "price")


def c12_cap_nights(w):
    capped = clean.upper_clip(F.col("minimum_nights"), 365)
    return _typed(w).select(*KEY, capped.alias("minimum_nights"))


def c13_adjusted_price(w):
    renamed = w["raw_calendar"].withColumnRenamed("price", "adjusted_price")
    return clean.type_calendar(renamed).select("listing_id", "date", "price")


def c13_listing_price(w):
    unpriced = w["raw_calendar"].drop("price")
    typed = clean.type_calendar(unpriced, w["listings_clean"].select("id", "price"))
    return typed.select("listing_id", "date", "price")


def c14_fill_night_price(w):
    return clean.fill_listing_median(w["calendar_typed"]).select(
        "listing_id", "date", "price"
    )


def c15_strip_breaks(w):
    rows, key = w["review_rows"], F.col("id").cast("bigint").alias("id")
    text = TEXT if TEXT in rows.columns else parsing.strip_breaks(F.col("comments")).alias("comments")
    return _digested(w, rows.select(key, text))


def c16_dropped_rows(w):
    return w.dropped_rows()


def c17_clean_listings(w):
    return w["listings_clean"]


def c18_clean_calendar(w):
    return w["calendar_clean"].drop("year_month")


def c19_clean_reviews(w):
    return _digested(w, w["reviews_kept"]).select(
        "id", "listing_id", "reviewer_id", "reviewer_name", "date", "comments_md5", "comments_length"
    )


# -- features -----------------------------------------------------------------------


def f01_nights(w):
    return w["metrics"].select(
        "id", "total_nights_tracked", "booked_nights", "calendar_start", "calendar_end"
    )


def f02_revenue(w):
    return w["metrics"].select("id", "revenue_estimate")


def f03_open_price(w):
    return w["metrics"].select("id", "avg_open_listing_price")


def f04_rates(w):
    return w["metrics"].select("id", "occupancy_rate", "adr", "revpar")


def f05_listing_metrics(w):
    return features.listing_metrics(features.monthly_sums(w["calendar_clean"]))


def f06_monthly(w):
    return features.monthly_aggregate(features.monthly_sums(w["calendar_clean"]))


def f07_host_experience(w):
    base = w["listings_clean"].select("id", "host_since")
    return features.host_experience(base, w.as_of).select("id", "host_experience_years")


def f08_experience_tier(w):
    base = w["listings_clean"].select("id", "host_since")
    return features.host_experience(base, w.as_of).select("id", "host_experience_tier")


def f09_price_category(w):
    base = w["listings_clean"].select("id", "price")
    return features.price_categories(base).select("id", "price_category")


def f10_recency(w):
    return features.recency(w["listings_clean"], w.as_of).select(
        "id", "listing_age_days", "days_since_last_review"
    )


def f11_stale(w):
    days = F.col("days_since_last_review")
    return features.recency(w["listings_clean"], w.as_of).select(
        "id",
        "is_stale_listing",
        features.stale_flag(days, never_reviewed_is_stale=True).alias("stale_if_never_reviewed"),
    )


def f12_composite_score(w):
    scores = [F.col(c) for c in features.SUB_SCORES]
    return w["listings_clean"].select(
        "id", features.composite_score(scores).alias("review_score_composite")
    )


def f13_amenity_count(w):
    return w["listings_clean"].select(
        "id", parsing.amenity_count(F.col("amenities")).alias("amenity_count")
    )


def f14_price_per_bedroom(w):
    return features.price_per_bedroom(w["listings_clean"]).select(
        "id", "bedrooms_for_valuation", "neighbourhood_median_price_per_bedroom"
    )


def f15_property_value(w):
    return features.property_value(w["listings_clean"]).select(
        "id", "estimated_property_value", "is_synthetic_valuation"
    )


def f16_roi(w):
    return w["master"].select("id", "estimated_annual_roi_pct")


def f17_pricing_gap(w):
    return w["master"].select("id", "pricing_gap")


def f18_pricing_signal(w):
    return w["master"].select("id", "pricing_signal")


def f19_master(w):
    return w["master"]


def f20_percentage_signal(w):
    return features.percentage_signal(w["master"]).select("id", "pricing_signal_pct")


# -- eight tables -------------------------------------------------------------------


def n01_neighbourhoods(w):
    return w["neighbourhoods"]


def n02_neighbourhood_key(w):
    return w["listings"].select("listing_id", "neighbourhood_id")


def n03_hosts(w):
    return w["hosts"]


def n04_listings(w):
    return w["listings"]


def n05_listing_performance(w):
    return w["listing_performance"]


def n06_listing_valuation(w):
    return w["listing_valuation"]


def n07_calendar_daily(w):
    return w["calendar_daily"]


def n08_reviews(w):
    kept = w["reviews_kept"]
    text = [c for c in (TEXT, "comments") if c in kept.columns]
    rows = normalize.reviews(kept, also=text)
    return _digested(w, rows).select(
        "review_id", "listing_id", "reviewer_id", "reviewer_name", "review_date", "comments_md5", "comments_length"
    )


def n09_review_scores(w):
    return w["review_scores"]


# -- audits -------------------------------------------------------------------------


def k01_value_ranges(w):
    return audit.range_audit(w.audited(), w.counts())


def k02_booked_within_tracked(w):
    return audit.booked_within_tracked(w["listing_performance"], w.counts())


def k03_uniqueness(w):
    return audit.uniqueness_audit(w.audited())


def k04_references(w):
    return audit.reference_audit(w.audited())


def k05_not_null(w):
    return audit.not_null_audit(w.audited(), w.counts())


# -- star ---------------------------------------------------------------------------


def d01_dim_date(w):
    return w["dim_date"]


def d02_dim_neighbourhood(w):
    return w["dim_neighbourhood"]


def d03_dim_host(w):
    return w["dim_host"]


def d04_dim_listing(w):
    return w["dim_listing"]


def d05_fact_performance(w):
    return w["fact_performance"]


def d06_fact_calendar(w):
    return w["fact_calendar"].drop("YearMonth")


def d07_fact_reviews(w):
    return w["fact_reviews"]


def d08_fact_review_scores(w):
    return w["fact_review_scores"]


def d09_star_integrity(w):
    w["review_rows"]  # first, as raw listings count them
    return star.star_integrity(w.star())


# -- data operations ----------------------------------------------------------------


def x01_incremental_load(w):
    """Two arrivals of nights, the later one correcting prices, loaded by month."""
    nights = w["calendar_daily"].withColumn("year_month", F.date_format("calendar_date", "yyyy-MM"))
    path = _folder(w, "incremental")
    first, second = incremental.split_arrivals(nights)
    incremental.upsert_nights(w.spark, path, first)
    incremental.upsert_nights(w.spark, path, second)
    loaded = tables.read_stage(w.spark, path, nights.schema)
    return loaded.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("nights"), F.sum("price").alias("price_total")
    )


def _refreshed(w) -> CalendarStore:
    """Both arrivals delivered to a store of this warehouse, once."""
    path = os.path.join(w.root, "calendar_store")
    store = CalendarStore(w.spark, path, w["listings"])
    first, second = incremental.split_arrivals(w["calendar_daily"])
    store.deliver(first, "first")
    store.deliver(second, "second")
    return store


def x01_refreshed_monthly(w) -> DataFrame:
    """Monthly sums after the second arrival, merged from its deltas."""
    return _refreshed(w).monthly().drop("booked_cents")


def x01_refreshed_metrics(w) -> DataFrame:
    return _refreshed(w).metrics()


def x01_refreshed_fact(w) -> DataFrame:
    return _refreshed(w).fact_monthly()


def x02_quality_gate(w):
    return audit.gate_report(w.audited(), library.q16_month_coverage(w), w.counts())


def x03_combine_snapshots(w):
    nights = w["calendar_daily"]
    first, second = incremental.split_arrivals(nights)
    combined = incremental.combine_snapshots({"2001-06-01": first, "2001-09-01": second})
    return combined.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("nights"), F.sum("price").alias("price_total")
    )


def x04_weekly_rollup(w):
    return incremental.weekly_rollup(w["calendar_daily"])


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if name[0] in "scfnkdx" and name[1:3].isdigit()
}
