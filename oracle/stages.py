"""SQL for sources, cleaning, features, tables, audits, star and data operations."""

from __future__ import annotations

from oracle.ctes import AS_OF, COMPOSITE, MEDIANS, ROOMS, div, even

NIGHT_SPLIT = "year(calendar_date) = 2001"


def cols(names: str, kind: str) -> str:
    return ", ".join(f"CAST({c} AS {kind}) AS {c}" for c in names.split())


def doubles(names: str) -> str:
    return cols(names, "DOUBLE")


def longs(names: str) -> str:
    return cols(names, "BIGINT")


def digest(c: str) -> str:
    return f"md5({c}) AS {c}_md5, CAST(length({c}) AS BIGINT) AS {c}_length"


COPY = "CAST(copy AS BIGINT) AS copy"

HOST_TABLE = f"""
SELECT host_id, host_since, {longs("is_superhost")}, {doubles("response_rate_pct")},
  response_time, {longs("identity_verified total_listings_count")},
  {doubles("experience_years")}, experience_tier FROM hosts
"""
LISTING_TABLE = f"""
SELECT listing_id, host_id, {longs("neighbourhood_id")}, property_type, room_type,
  {longs("accommodates amenity_count minimum_nights maximum_nights instant_bookable")},
  {longs("is_stale_listing")}, {doubles("bedrooms beds bathrooms base_price")},
  price_category, first_review_date, last_review_date FROM listings
"""
CLEAN_LISTINGS = f"""
SELECT id, host_id, host_since, host_is_superhost, {doubles("host_response_rate")},
  host_response_rate_missing, host_response_time, host_identity_verified,
  {longs("host_total_listings_count accommodates minimum_nights maximum_nights")},
  {longs("number_of_reviews number_of_reviews_ltm")},
  neighbourhood_cleansed, neighbourhood_group_cleansed, latitude, longitude, property_type,
  room_type, {doubles("bathrooms bedrooms beds price reviews_per_month")}, bathrooms_text,
  amenities, first_review, last_review,
  {doubles("review_scores_rating review_scores_cleanliness review_scores_checkin")},
  {doubles("review_scores_communication review_scores_location review_scores_value")},
  instant_bookable
"""

PERFORMANCE_TABLE = f"""
SELECT listing_id, {longs("total_nights_tracked booked_nights")},
  {doubles("occupancy_rate revenue_estimate adr revpar avg_open_listing_price pricing_gap")},
  pricing_signal FROM listing_performance
"""


def rule(table: str, name: str, broken: str) -> str:
    name = name.replace("'", "''")
    return (
        f"SELECT '{table}' AS table_name, '{name}' AS rule, "
        f"CAST(count(*) FILTER (WHERE {broken}) AS BIGINT) AS violations FROM {table}"
    )


RANGES = [
    ("hosts", "response_rate_pct between 0 and 100", "NOT response_rate_pct BETWEEN 0 AND 100"),
    ("hosts", "total_listings_count >= 0", "total_listings_count < 0"),
    ("hosts", "experience_years >= 0", "experience_years < 0"),
    ("listings", "accommodates > 0", "accommodates <= 0"),
    ("listings", "bedrooms >= 0", "bedrooms < 0"),
    ("listings", "beds >= 0", "beds < 0"),
    ("listings", "bathrooms >= 0", "bathrooms < 0"),
    ("listings", "amenity_count >= 0", "amenity_count < 0"),
    ("listings", "base_price >= 0", "base_price < 0"),
    ("listings", "minimum_nights >= 1", "minimum_nights < 1"),
    ("listing_performance", "total_nights_tracked > 0", "total_nights_tracked <= 0"),
    ("listing_performance", "booked_nights >= 0", "booked_nights < 0"),
    (
        "listing_performance",
        "occupancy_rate between 0 and 1",
        "NOT occupancy_rate BETWEEN 0 AND 1",
    ),
    ("listing_performance", "revenue_estimate >= 0", "revenue_estimate < 0"),
    ("listing_valuation", "estimated_property_value >= 0", "estimated_property_value < 0"),
] + [
    ("review_scores", f"{c} between 0 and 5", f"NOT {c} BETWEEN 0 AND 5")
    for c in ("rating", "cleanliness", "checkin", "communication", "location_score", "value_score")
]
K01 = " UNION ALL ".join(rule(*x) for x in RANGES)
K02 = rule(
    "listing_performance",
    "booked_nights <= total_nights_tracked",
    "booked_nights > total_nights_tracked",
)


def unique(table: str, key: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'unique {key}' AS rule, "
        f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations "
        f"FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY {key})"
    )


K03 = " UNION ALL ".join(
    unique(t, k)
    for t, k in [
        ("neighbourhoods", "neighbourhood_id"),
        ("neighbourhoods", "neighbourhood_name"),
        ("hosts", "host_id"),
        ("listings", "listing_id"),
        ("listing_performance", "listing_id"),
        ("listing_valuation", "listing_id"),
        ("calendar_daily", "listing_id, calendar_date"),
        ("reviews", "review_id"),
        ("review_scores", "listing_id"),
    ]
)


def orphan(child: str, parent: str, key: str, label: str, rule_text: str, parent_key=None) -> str:
    return (
        f"SELECT '{label}' AS table_name, '{rule_text}' AS rule, "
        f"CAST(count(*) AS BIGINT) AS violations FROM {child} c WHERE c.{key} IS NOT NULL "
        f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key or key} = c.{key})"
    )


K04 = " UNION ALL ".join(
    orphan(c, p, k, c, f"{k} in {p}")
    for c, p, k in [
        ("listings", "hosts", "host_id"),
        ("listings", "neighbourhoods", "neighbourhood_id"),
        ("listing_performance", "listings", "listing_id"),
        ("listing_valuation", "listings", "listing_id"),
        ("calendar_daily", "listings", "listing_id"),
        ("reviews", "listings", "listing_id"),
        ("review_scores", "listings", "listing_id"),
    ]
)
K05 = " UNION ALL ".join(
    rule(t, f"{c} filled", f"{c} IS NULL")
    for t, names in {
        "neighbourhoods": "neighbourhood_name",
        "listings": "host_id neighbourhood_id room_type base_price",
        "listing_performance": "total_nights_tracked booked_nights",
        "listing_valuation": "is_synthetic_valuation",
        "calendar_daily": "listing_id calendar_date is_available",
        "reviews": "listing_id review_date",
    }.items()
    for c in names.split()
)
COVERAGE = """
SELECT strftime(m, '%Y-%m') AS expected_month,
  CASE WHEN strftime(m, '%Y-%m') IN (SELECT strftime(calendar_date, '%Y-%m') FROM calendar_daily)
       THEN 'Present' ELSE 'MISSING' END AS coverage_status
FROM (SELECT unnest(generate_series(date_trunc('month', min(calendar_date)),
        date_trunc('month', max(calendar_date)), INTERVAL 1 MONTH)) AS m FROM calendar_daily)
"""
X02 = " UNION ALL ".join(
    [
        K01,
        K02,
        K03,
        K04,
        K05,
        "SELECT 'calendar_daily' AS table_name, 'every month covered' AS rule, "
        "CAST(count(*) FILTER (WHERE coverage_status = 'MISSING') AS BIGINT) AS violations "
        f"FROM ({COVERAGE})",
    ]
)

DIMS = {
    "DimDate": "dim_date",
    "DimListing": "dim_listing",
    "DimHost": "dim_host",
    "DimNeighbourhood": "dim_neighbourhood",
}
FACTS = {
    "FactCalendarDaily": "fact_calendar",
    "FactListingPerformance": "fact_performance",
    "FactReviews": "fact_reviews",
    "FactReviewScores": "fact_review_scores",
}
LINKS = [
    ("DimDate", "DateKey", "FactCalendarDaily", "DateKey"),
    ("DimDate", "DateKey", "FactReviews", "ReviewDateKey"),
] + [
    (dim, key, fact, key)
    for dim, key in (
        ("DimListing", "ListingKey"),
        ("DimHost", "HostKey"),
        ("DimNeighbourhood", "NeighbourhoodKey"),
    )
    for fact in FACTS
]
D09 = " UNION ALL ".join(
    orphan(FACTS[f], DIMS[d], fk, f, f"{fk} in {d}", k) for d, k, f, fk in LINKS
)

SNAPSHOT = f"""
SELECT calendar_date, listing_id, is_available,
  CASE WHEN {NIGHT_SPLIT} THEN CAST(price + 1 AS DECIMAL(10,2)) ELSE price END AS price,
  CASE WHEN {NIGHT_SPLIT} THEN DATE '2001-09-01' ELSE DATE '2001-06-01' END AS snapshot_date
FROM calendar_daily
"""

DROPPED = """
SELECT 'listings' AS table_name, 'no price' AS reason, count(*) AS rows_before,
  count(*) FILTER (WHERE price IS NULL) AS rows_dropped FROM typed_listings
UNION ALL SELECT 'listings', 'duplicate id', count(*), count(*) - count(DISTINCT id)
  FROM typed_listings WHERE price IS NOT NULL
UNION ALL SELECT 'calendar', 'no date or state', count(*),
  count(*) FILTER (WHERE date IS NULL OR available IS NULL) FROM typed_calendar
UNION ALL SELECT 'calendar', 'unread date text', count(*), 0 FROM typed_calendar
UNION ALL SELECT 'reviews', 'no date', count(*), count(*) FILTER (WHERE date IS NULL)
  FROM raw_reviews
UNION ALL SELECT 'reviews', 'unread date text', count(*), 0 FROM raw_reviews
UNION ALL SELECT 'reviews', 'duplicate id', count(*), count(*) - count(DISTINCT id)
  FROM raw_reviews WHERE date IS NOT NULL
"""

def _bad(table: str, raw: str, column: str, parsed: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"""SELECT '{table}' AS table_name, '{column}' AS "column", {text} AS text
      FROM {raw} WHERE trim({text}) NOT IN ('nan', 'None', '<NA>', '') AND {parsed} IS NULL"""


def _flag(column: str) -> str:
    return f"CASE WHEN {column} IN ('t', 'f') THEN 1 END"


REJECTED = " UNION ALL ".join(
    [
        _bad("listings", "raw_listings", "price", "try_cast(translate(price, '$,', '') AS DOUBLE)"),
        _bad("listings", "raw_listings", "host_response_rate", "try_cast(replace(host_response_rate, '%', '') AS DOUBLE)"),
        *[_bad("listings", "raw_listings", c, _flag(c)) for c in ("host_is_superhost", "host_identity_verified", "instant_bookable")],
        *[_bad("listings", "raw_listings", c, f"try_cast(CAST({c} AS VARCHAR) AS DOUBLE)") for c in ("bedrooms", "beds", "accommodates", "minimum_nights", "reviews_per_month")],
    ]
)

SQL = {
    "s01_read_csv": f"SELECT id, {COPY}, price, amenities, bathrooms_text, host_response_rate, "
    "neighbourhood_cleansed, room_type FROM raw_listings",
    "s02_keep_columns": "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(34 AS BIGINT) AS "
    "columns_kept, 'availability_365, bathrooms, calculated_host_listings_count' AS "
    "columns_missing FROM raw_listings",
    "s03_required_columns": "SELECT available, CAST(count(*) AS BIGINT) AS nights "
    "FROM raw_calendar GROUP BY 1",
    "s04_typed_reread": "SELECT id, host_since, first_review, last_review, host_is_superhost, "
    "is_stale_listing FROM master",
    "s05_written_outputs": "SELECT year_month, CAST(count(*) AS BIGINT) AS listings, "
    "CAST(sum(revenue) AS DOUBLE) AS revenue FROM monthly_agg GROUP BY 1",
    "s06_load_csv": LISTING_TABLE,
    "s07_load_counts": "SELECT "
    + ", ".join(
        f"CAST((SELECT count(*) FROM {t}) AS BIGINT) AS {t}"
        for t in (
            "neighbourhoods hosts listings listing_performance listing_valuation "
            "calendar_daily reviews review_scores"
        ).split()
    ),
    "s08_read_table": "SELECT CAST(NeighbourhoodKey AS BIGINT) AS NeighbourhoodKey, "
    "NeighbourhoodName, NeighbourhoodGroup FROM dim_neighbourhood",
    "c01_parse_price": f"SELECT id, {COPY}, {doubles('price')} FROM typed_listings",
    "c02_parse_percent": f"SELECT id, {COPY}, host_response_rate FROM typed_listings",
    "c03_parse_dates": f"SELECT id, {COPY}, host_since, first_review, last_review "
    "FROM typed_listings",
    "c03_rejected_cells": f"""SELECT table_name, "column", text, CAST(count(*) AS BIGINT) AS n
      FROM ({REJECTED}) GROUP BY 1, 2, 3""",
    "c04_parse_flags": f"SELECT id, {COPY}, host_is_superhost, host_identity_verified, "
    "instant_bookable FROM typed_listings",
    "c05_bathrooms_from_text": f"SELECT id, {COPY}, bathrooms FROM typed_listings",
    "c06_fill_medians": f"SELECT id, {COPY}, "
    + ", ".join(f"CAST(coalesce({c}, m_{c}) AS DOUBLE) AS {c}" for c in MEDIANS)
    + " FROM typed_listings CROSS JOIN medians",
    "c07_flag_response_rate": f"SELECT id, {COPY}, coalesce(host_response_rate, 0) AS "
    "host_response_rate, host_response_rate IS NULL AS host_response_rate_missing "
    "FROM typed_listings",
    "c08_fill_superhost": f"SELECT id, {COPY}, coalesce(host_is_superhost, false) AS "
    "host_is_superhost FROM typed_listings",
    "c09_drop_missing": f"SELECT id, {COPY}, {doubles('price')} FROM typed_listings "
    "WHERE price IS NOT NULL",
    "c10_dedupe": f"SELECT id, {COPY}, host_id, {doubles('price')} FROM survivors",
    "c11_cap_price": f"SELECT id, {doubles('price')} FROM listings_clean",
    "c12_cap_nights": f"SELECT id, {COPY}, CAST(CASE WHEN minimum_nights > 365 THEN 365 "
    "ELSE minimum_nights END AS BIGINT) AS minimum_nights FROM typed_listings",
    "c13_adjusted_price": f"SELECT listing_id, date, {doubles('price')} FROM typed_calendar",
    "c13_listing_price": "SELECT listing_id, date, CAST(l.price AS DOUBLE) AS price "
    "FROM raw_calendar c LEFT JOIN listings_clean l ON l.id = c.listing_id",
    "c14_fill_night_price": f"SELECT listing_id, date, {doubles('price')} FROM filled_calendar",
    "c15_strip_breaks": f"SELECT id, {digest('comments')} FROM reviews_clean",
    "c16_dropped_rows": f"SELECT table_name, reason, {longs('rows_before rows_dropped')} "
    f"FROM ({DROPPED})",
    "c17_clean_listings": CLEAN_LISTINGS + " FROM listings_clean",
    "c18_clean_calendar": f"SELECT listing_id, date, available, {doubles('price')} "
    "FROM calendar_clean",
    "c19_clean_reviews": f"SELECT id, listing_id, reviewer_id, reviewer_name, date, "
    f"{digest('comments')} FROM reviews_clean",
    "f01_nights": f"SELECT id, {longs('total_nights_tracked booked_nights')}, calendar_start, "
    "calendar_end FROM metrics",
    "f02_revenue": f"SELECT id, {doubles('revenue_estimate')} FROM metrics",
    "f03_open_price": "SELECT id, avg_open_listing_price FROM metrics",
    "f04_rates": f"SELECT id, {doubles('occupancy_rate adr revpar')} FROM kpis",
    "f05_listing_metrics": f"SELECT id, {longs('total_nights_tracked booked_nights')}, "
    f"calendar_start, calendar_end, avg_open_listing_price, "
    f"{doubles('revenue_estimate occupancy_rate adr revpar')} FROM kpis",
    "f06_monthly": f"SELECT id, year_month, {longs('nights_tracked nights_booked')}, "
    f"{doubles('revenue occupancy_rate')} FROM monthly_agg",
    "f07_host_experience": "SELECT id, CAST(host_experience_years AS DOUBLE) AS "
    "host_experience_years FROM experience",
    "f08_experience_tier": "SELECT id, host_experience_tier FROM features",
    "f09_price_category": "SELECT id, price_category FROM features",
    "f10_recency": f"SELECT id, {longs('listing_age_days days_since_last_review')} FROM features",
    "f11_stale": "SELECT id, is_stale_listing, coalesce(days_since_last_review > 365, true) "
    "AS stale_if_never_reviewed FROM features",
    "f12_composite_score": f"SELECT id, CAST({COMPOSITE} AS DOUBLE) AS review_score_composite "
    "FROM listings_clean",
    "f13_amenity_count": f"SELECT id, {longs('amenity_count')} FROM features",
    "f14_price_per_bedroom": f"SELECT id, CAST({ROOMS} AS DOUBLE) AS bedrooms_for_valuation, "
    "CAST(per_room AS DOUBLE) AS neighbourhood_median_price_per_bedroom FROM listings_clean "
    "LEFT JOIN room_prices ON name = neighbourhood_cleansed",
    "f15_property_value": f"SELECT id, {doubles('estimated_property_value')}, "
    "is_synthetic_valuation FROM features",
    "f16_roi": f"SELECT id, {doubles('estimated_annual_roi_pct')} FROM master",
    "f17_pricing_gap": f"SELECT id, {doubles('pricing_gap')} FROM master",
    "f18_pricing_signal": "SELECT id, pricing_signal FROM master",
    "f19_master": CLEAN_LISTINGS
    + f""", {doubles("host_experience_years review_score_composite bedrooms_for_valuation")},
  host_experience_tier, price_category, is_stale_listing, is_synthetic_valuation,
  {longs("listing_age_days days_since_last_review amenity_count")},
  {longs("total_nights_tracked booked_nights")}, calendar_start, calendar_end,
  {doubles("neighbourhood_median_price_per_bedroom estimated_property_value revenue_estimate")},
  {doubles("avg_open_listing_price occupancy_rate adr revpar estimated_annual_roi_pct")},
  {doubles("pricing_gap")}, pricing_signal FROM master""",
    "f20_percentage_signal": f"""SELECT id, CASE WHEN rel > 0.2 THEN 'Possibly Overpriced'
      WHEN rel < -0.2 THEN 'Possibly Underpriced' ELSE 'Well-Priced' END AS pricing_signal_pct
      FROM (SELECT id, {div("pricing_gap", "price")} AS rel FROM master)""",
    "n01_neighbourhoods": f"SELECT {longs('neighbourhood_id')}, neighbourhood_name, "
    "neighbourhood_group FROM neighbourhoods",
    "n02_neighbourhood_key": f"SELECT listing_id, {longs('neighbourhood_id')} FROM listings",
    "n03_hosts": HOST_TABLE,
    "n04_listings": LISTING_TABLE,
    "n05_listing_performance": PERFORMANCE_TABLE,
    "n06_listing_valuation": "SELECT listing_id, "
    f"{doubles('estimated_property_value estimated_annual_roi_pct')}, "
    f"{longs('is_synthetic_valuation valuation_multiplier')} FROM listing_valuation",
    "n07_calendar_daily": f"SELECT listing_id, calendar_date, {longs('is_available')}, "
    f"{doubles('price')} FROM calendar_daily",
    "n08_reviews": "SELECT review_id, listing_id, reviewer_id, reviewer_name, review_date, "
    f"{digest('comments')} FROM reviews",
    "n09_review_scores": "SELECT listing_id, "
    f"{doubles('rating cleanliness checkin communication location_score value_score')}, "
    f"{doubles('composite_score')} FROM review_scores",
    "k01_value_ranges": K01,
    "k02_booked_within_tracked": K02,
    "k03_uniqueness": K03,
    "k04_references": K04,
    "k05_not_null": K05,
    "d01_dim_date": "SELECT * FROM dim_date",
    "d02_dim_neighbourhood": "SELECT CAST(NeighbourhoodKey AS BIGINT) AS NeighbourhoodKey, "
    "NeighbourhoodName, NeighbourhoodGroup FROM dim_neighbourhood",
    "d03_dim_host": f"SELECT HostKey, HostSince, ExperienceTier, "
    f"{longs('IsSuperhost TotalListingsCount')}, {doubles('ResponseRatePct ExperienceYears')} "
    "FROM dim_host",
    "d04_dim_listing": "SELECT ListingKey, PropertyType, RoomType, PriceCategory, "
    "FirstReviewDate, LastReviewDate, "
    f"{longs('Accommodates AmenityCount MinimumNights MaximumNights InstantBookable')}, "
    f"{longs('IsStaleListing PriceCategorySort')}, "
    f"{doubles('Bedrooms Beds Bathrooms BasePrice')} FROM dim_listing",
    "d05_fact_performance": "SELECT ListingKey, HostKey, PricingSignal, "
    f"{longs('NeighbourhoodKey TotalNightsTracked BookedNights IsSyntheticValuation')}, "
    f"{doubles('OccupancyRate RevenueEstimate ADR RevPAR AvgOpenListingPrice PricingGap')}, "
    f"{doubles('EstimatedPropertyValue EstimatedAnnualROIPct')} FROM fact_performance",
    "d06_fact_calendar": "SELECT ListingKey, Date, DateKey, HostKey, "
    f"{longs('NeighbourhoodKey IsAvailable IsBooked')}, {doubles('Price BookedRevenue')} "
    "FROM fact_calendar",
    "d07_fact_reviews": "SELECT ReviewKey, ListingKey, ReviewDate, ReviewDateKey, HostKey, "
    f"{longs('NeighbourhoodKey ReviewCount')} FROM fact_reviews",
    "d08_fact_review_scores": "SELECT ListingKey, HostKey, "
    f"{longs('NeighbourhoodKey')}, "
    f"{doubles('Rating Cleanliness Checkin Communication LocationScore ValueScore')}, "
    f"{doubles('CompositeScore')} FROM fact_review_scores",
    "d09_star_integrity": D09,
    "x01_incremental_load": "SELECT strftime(calendar_date, '%Y-%m') AS year_month, "
    "CAST(count(*) AS BIGINT) AS nights, CAST(sum(price) AS DOUBLE) AS price_total "
    f"FROM ({SNAPSHOT}) GROUP BY 1",
    # a rebuild from all nights as they stand after both arrivals
    "x01_refreshed_monthly": f"""SELECT listing_id AS id, strftime(calendar_date, '%Y-%m') AS year_month,
      CAST(count(*) AS BIGINT) AS nights_tracked,
      CAST(count(*) FILTER (WHERE is_available = 0) AS BIGINT) AS nights_booked,
      CAST(sum(price) FILTER (WHERE is_available = 0) AS DOUBLE) AS booked_revenue,
      CAST(sum(price) FILTER (WHERE is_available = 1) AS DOUBLE) AS open_price_sum,
      CAST(count(price) FILTER (WHERE is_available = 1) AS BIGINT) AS open_nights,
      min(calendar_date) AS first_night, max(calendar_date) AS last_night
      FROM ({SNAPSHOT}) GROUP BY 1, 2""",
    "x01_refreshed_metrics": f"""SELECT id, {longs('total_nights_tracked booked_nights')},
      calendar_start, calendar_end, open_sum / nullif(open_nights, 0) AS avg_open_listing_price,
      CAST(revenue AS DOUBLE) AS revenue_estimate,
      {even("booked_nights / CAST(total_nights_tracked AS DOUBLE)", 4)} AS occupancy_rate,
      CASE WHEN booked_nights > 0 THEN {even("CAST(revenue AS DOUBLE) / booked_nights")} ELSE 0 END AS adr,
      {even("CAST(revenue AS DOUBLE) / total_nights_tracked")} AS revpar
      FROM (SELECT listing_id AS id, count(*) AS total_nights_tracked,
        count(*) FILTER (WHERE is_available = 0) AS booked_nights,
        min(calendar_date) AS calendar_start, max(calendar_date) AS calendar_end,
        coalesce(sum(price) FILTER (WHERE is_available = 0), 0) AS revenue,
        CAST(sum(price) FILTER (WHERE is_available = 1) AS DOUBLE) AS open_sum,
        count(price) FILTER (WHERE is_available = 1) AS open_nights
        FROM ({SNAPSHOT}) GROUP BY 1)""",
    "x01_refreshed_fact": f"""SELECT s.listing_id AS ListingKey, strftime(calendar_date, '%Y-%m') AS YearMonth,
      CAST(coalesce(sum(price) FILTER (WHERE is_available = 0), 0) AS DOUBLE) AS BookedRevenue,
      CAST(count(*) FILTER (WHERE is_available = 0) AS BIGINT) AS IsBooked, CAST(count(*) AS BIGINT) AS Nights,
      host_id AS HostKey, neighbourhood_id AS NeighbourhoodKey
      FROM ({SNAPSHOT}) s LEFT JOIN listings l ON l.listing_id = s.listing_id
      GROUP BY 1, 2, host_id, neighbourhood_id""",
    "x02_quality_gate": X02,
    "x03_combine_snapshots": "SELECT snapshot_date, CAST(count(*) AS BIGINT) AS nights, "
    f"CAST(sum(price) AS DOUBLE) AS price_total FROM ({SNAPSHOT}) GROUP BY 1",
    "x04_weekly_rollup": "SELECT listing_id, CAST(date_trunc('week', calendar_date) AS DATE) AS "
    "week_start, CAST(count(*) AS BIGINT) AS nights_tracked, "
    "CAST(count(*) FILTER (WHERE is_available = 0) AS BIGINT) AS nights_booked, "
    "CAST(coalesce(sum(price) FILTER (WHERE is_available = 0), 0) AS DOUBLE) AS revenue "
    "FROM calendar_daily GROUP BY 1, 2",
}
