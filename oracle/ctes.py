"""Named SQL building blocks; ``with_blocks`` prefixes a query with the ones it uses."""

from __future__ import annotations

import re

AS_OF = "DATE '2002-01-01'"


def r(expr: str, digits: int = 2) -> str:
    """SQL's ROUND: halves away from zero."""
    scale, x = f"CAST({10 ** digits}.0 AS DOUBLE)", f"CAST({expr} AS DOUBLE)"
    size = f"floor(abs({x}) * {scale} + 0.5) / {scale}"
    return f"(CASE WHEN {x} < 0 THEN -({size}) ELSE {size} END + CAST(0 AS DOUBLE))"


def even(expr: str, digits: int = 2) -> str:
    """Rounding of data frames: halves to the even neighbour."""
    return f"round_even(CAST({expr} AS DOUBLE), {digits})"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def avg(c: str) -> str:
    return div(f"sum({c})", f"count({c})")


def pct1(c: str) -> str:
    return r(f"{c} * 100", 1)


def num(text: str) -> str:
    """Text to number with the null tokens."""
    return (
        f"try_cast(CASE WHEN trim({text}) NOT IN ('nan','None','<NA>','') "
        f"THEN trim({text}) END AS DOUBLE)"
    )


MEDIANS = [
    "bedrooms",
    "beds",
    "bathrooms",
    "review_scores_rating",
    "review_scores_cleanliness",
    "review_scores_checkin",
    "review_scores_communication",
    "review_scores_location",
    "review_scores_value",
    "reviews_per_month",
]

ROOM = "['Entire home/apt','Private room','Shared room','Hotel room']"
RESPONSE = "['within an hour','within a few hours','within a day']"

BLOCKS: dict[str, str] = {}

BLOCKS["fl"] = """
SELECT l_partkey, m.l_suppkey AS sk, m.l_discount AS disc, m.l_tax AS tax,
       m.l_linenumber AS ln, m.l_quantity AS q
FROM (SELECT l_partkey, min({'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey,
        'l_linenumber': l_linenumber, 'l_suppkey': l_suppkey, 'l_quantity': l_quantity,
        'l_extendedprice': l_extendedprice, 'l_discount': l_discount, 'l_tax': l_tax}) AS m
      FROM lineitem GROUP BY l_partkey)
"""
BLOCKS["priced_part"] = """
SELECT *, CAST(floor(p_retailprice * (10 + p_size) + 0.5) / 100 AS DECIMAL(10,2)) AS bp FROM part
"""
BLOCKS["raw_reviews"] = r"""
SELECT o_orderkey AS id, m.l_partkey AS listing_id, o_custkey AS reviewer_id,
       c_name AS reviewer_name, CAST(o_orderdate AS DATE) AS date,
       replace(d.text, chr(10), '<br/>') AS comments
FROM orders o
JOIN (SELECT l_orderkey, min({'l_shipdate': l_shipdate, 'l_partkey': l_partkey}) AS m
      FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
"""
BLOCKS["review_stats"] = """
SELECT m.l_partkey AS listing_id, count(*) AS n_reviews,
       count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '2001-01-01') AS n_recent,
       min(CAST(o_orderdate AS DATE)) AS d_first, max(CAST(o_orderdate AS DATE)) AS d_last
FROM orders o
JOIN (SELECT l_orderkey, min({'l_shipdate': l_shipdate, 'l_partkey': l_partkey}) AS m
      FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
GROUP BY 1
"""
BLOCKS["raw_calendar"] = """
SELECT l_partkey AS listing_id, CAST(l_shipdate AS DATE) AS date,
       CASE WHEN (l_partkey + sum(l_linenumber)) % 211 = 0 THEN NULL
            WHEN bool_or(l_returnflag = 'R') THEN 'f' ELSE 't' END AS available,
       CASE WHEN (l_partkey % 41 = 0 AND sum(l_linenumber) % 2 = 0) OR l_partkey % 401 = 1 THEN NULL
            ELSE '$' || CAST(max(CAST(floor(CAST(bp AS DOUBLE) * (1 + 4 * (l_tax - l_discount))
                 * 100 + 0.5) / 100 AS DECIMAL(10,2))) AS VARCHAR) END AS price
FROM lineitem JOIN priced_part ON p_partkey = l_partkey
GROUP BY l_partkey, CAST(l_shipdate AS DATE)
"""
BLOCKS["raw_listings"] = f"""
SELECT p_partkey AS id, sk AS host_id,
  CAST(DATE '2001-12-31' - CAST((s_suppkey * 371) % 3650 AS INTEGER) AS DATE) AS host_since,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_acctbal >= 5000 THEN 't' ELSE 'f' END
    AS host_is_superhost,
  CASE WHEN s_suppkey % 17 = 0 THEN 'N/A' ELSE CAST((s_suppkey * 7) % 101 AS VARCHAR) || '%' END
    AS host_response_rate,
  {RESPONSE}[s_suppkey % 3 + 1] AS host_response_time,
  count(*) OVER (PARTITION BY sk) AS host_total_listings_count,
  CASE WHEN s_suppkey % 4 = 0 THEN 'f' ELSE 't' END AS host_identity_verified,
  n_name AS neighbourhood_cleansed, r_name AS neighbourhood_group_cleansed,
  40 + n_nationkey / CAST(100 AS DOUBLE) AS latitude,
  -74 - n_nationkey / CAST(100 AS DOUBLE) AS longitude,
  p_type AS property_type, {ROOM}[p_size % 4 + 1] AS room_type,
  1 + p_size % 8 AS accommodates, CAST(1 + p_size % 4 AS DOUBLE) AS beds,
  CASE WHEN p_partkey % 3 = 0 THEN 'Half-bath'
       ELSE CAST(1 + p_size % 3 AS VARCHAR) || '.5 baths' END AS bathrooms_text,
  CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_size % 5 AS DOUBLE) END AS bedrooms,
  CASE WHEN p_size % 30 = 0 THEN '[]' ELSE '["x"' || repeat(', "x"', p_size % 30 - 1) || ']' END
    AS amenities,
  CASE WHEN p_partkey % 97 <> 0 THEN '$' || format('{{:,.2f}}',
       CAST(CASE WHEN p_partkey % 250 = 7 THEN bp * 50 ELSE bp END AS DOUBLE)) END AS price,
  CASE WHEN p_partkey % 333 = 5 THEN 1000 ELSE 1 + p_partkey % 30 END AS minimum_nights,
  1125 AS maximum_nights,
  coalesce(n_reviews, 0) AS number_of_reviews, coalesce(n_recent, 0) AS number_of_reviews_ltm,
  d_first AS first_review, d_last AS last_review,
  CASE WHEN p_partkey % 19 <> 0 THEN 100 - 200 * disc END AS review_scores_rating,
  5 - 10 * disc AS review_scores_cleanliness,
  5 - CAST(12.5 AS DOUBLE) * tax AS review_scores_checkin,
  5 - (ln - 1) / CAST(6 AS DOUBLE) AS review_scores_communication,
  CAST(3.5 AS DOUBLE) + CAST(1.5 AS DOUBLE) * n_nationkey / 24 AS review_scores_location,
  5 - q / CAST(25 AS DOUBLE) AS review_scores_value,
  CASE WHEN p_partkey % 2 = 0 THEN 't' ELSE 'f' END AS instant_bookable,
  coalesce(n_reviews, 0) / CAST(84 AS DOUBLE) AS reviews_per_month,
  unnest(CASE WHEN p_partkey % 40 = 3 THEN [1, 2] ELSE [1] END) AS copy
FROM fl JOIN priced_part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey
LEFT JOIN review_stats rs ON rs.listing_id = p_partkey
"""
BLOCKS["typed_listings"] = f"""
SELECT * REPLACE (
    CAST({num("regexp_replace(price, '[$,]', '', 'g')")} AS DECIMAL(18,6)) AS price,
    {num("replace(host_response_rate, '%', '')")} AS host_response_rate,
    CASE host_is_superhost WHEN 't' THEN true WHEN 'f' THEN false END AS host_is_superhost,
    CASE host_identity_verified WHEN 't' THEN true WHEN 'f' THEN false END
      AS host_identity_verified,
    CASE instant_bookable WHEN 't' THEN true WHEN 'f' THEN false END AS instant_bookable),
  try_cast(nullif(regexp_extract(bathrooms_text, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS bathrooms
FROM raw_listings
"""
BLOCKS["medians"] = "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}" for c in MEDIANS
) + " FROM typed_listings"
BLOCKS["survivors"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY copy) AS rn
  FROM typed_listings WHERE price IS NOT NULL) WHERE rn = 1
"""
BLOCKS["price_bounds"] = """
SELECT greatest(q1 - 1.5 * (q3 - q1), 0) AS low, q3 + 1.5 * (q3 - q1) AS high
FROM (SELECT CAST(quantile_cont(CAST(price AS DOUBLE), 0.25) AS DECIMAL(18,6)) AS q1,
             CAST(quantile_cont(CAST(price AS DOUBLE), 0.75) AS DECIMAL(18,6)) AS q3
      FROM survivors)
"""
BLOCKS["listings_clean"] = (
    """
SELECT s.* EXCLUDE (copy, """
    + ", ".join(MEDIANS)
    + """, price, host_response_rate, host_is_superhost, minimum_nights),
  """
    + ", ".join(f"coalesce(s.{c}, m_{c}) AS {c}" for c in MEDIANS)
    + """,
  CAST(CASE WHEN price < low THEN low WHEN price > high THEN high ELSE price END
       AS DECIMAL(18,6)) AS price,
  host_response_rate IS NULL AS host_response_rate_missing,
  coalesce(host_response_rate, 0) AS host_response_rate,
  coalesce(host_is_superhost, false) AS host_is_superhost,
  CASE WHEN minimum_nights > 365 THEN 365 ELSE minimum_nights END AS minimum_nights
FROM survivors s, medians, price_bounds
"""
)
BLOCKS["typed_calendar"] = f"""
SELECT listing_id, date,
  CASE available WHEN 't' THEN true WHEN 'f' THEN false END AS available,
  CAST({num("regexp_replace(price, '[$,]', '', 'g')")} AS DECIMAL(18,6)) AS price
FROM raw_calendar
"""
BLOCKS["night_medians"] = """
SELECT listing_id, CAST(quantile_cont(CAST(price AS DOUBLE), 0.5) AS DECIMAL(18,6)) AS med
FROM typed_calendar WHERE price IS NOT NULL GROUP BY 1
"""
BLOCKS["filled_calendar"] = """
SELECT c.listing_id, date, available,
  CAST(coalesce(price, med, 0) AS DECIMAL(18,6)) AS price
FROM typed_calendar c LEFT JOIN night_medians m ON m.listing_id = c.listing_id
"""
BLOCKS["calendar_clean"] = """
SELECT * FROM filled_calendar WHERE date IS NOT NULL AND available IS NOT NULL
"""
# Every character that counts as white space around a text.
WHITE = "'" + (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
) + "'"
BLOCKS["reviews_clean"] = rf"""
SELECT id, listing_id, reviewer_id, reviewer_name, date,
  trim(regexp_replace(comments, '<br\s*/?>', ' ', 'g'), {WHITE}) AS comments
FROM raw_reviews WHERE date IS NOT NULL
"""
BLOCKS["metrics"] = f"""
SELECT listing_id AS id, count(date) AS total_nights_tracked,
  count(*) FILTER (WHERE NOT available) AS booked_nights,
  min(date) AS calendar_start, max(date) AS calendar_end,
  CAST(coalesce(sum(price) FILTER (WHERE NOT available), 0) AS DECIMAL(18,6)) AS revenue_estimate,
  {div("sum(price) FILTER (WHERE available)", "count(price) FILTER (WHERE available)")}
    AS avg_open_listing_price
FROM calendar_clean GROUP BY 1
"""
BLOCKS["kpis"] = f"""
SELECT *,
  CAST({even(div("booked_nights", "total_nights_tracked"), 4)} AS DECIMAL(5,4)) AS occupancy_rate,
  CAST(CASE WHEN booked_nights > 0 THEN {even(div("revenue_estimate", "booked_nights"))} ELSE 0 END
       AS DECIMAL(12,2)) AS adr,
  CAST(CASE WHEN total_nights_tracked > 0
       THEN {even(div("revenue_estimate", "total_nights_tracked"))} ELSE 0 END
       AS DECIMAL(12,2)) AS revpar
FROM metrics
"""
BLOCKS["monthly_agg"] = f"""
SELECT id, year_month, nights_tracked, nights_booked, revenue,
  CAST({even(div("nights_booked", "nights_tracked"), 4)} AS DECIMAL(5,4)) AS occupancy_rate
FROM (SELECT listing_id AS id, strftime(date, '%Y-%m') AS year_month,
        count(date) AS nights_tracked, count(*) FILTER (WHERE NOT available) AS nights_booked,
        CAST(coalesce(sum(price) FILTER (WHERE NOT available), 0) AS DECIMAL(18,6)) AS revenue
      FROM calendar_clean GROUP BY 1, 2)
"""
YEARS = even(f"date_diff('day', host_since, {AS_OF}) / CAST(365.25 AS DOUBLE)", 1)
BLOCKS["experience"] = f"""
SELECT id, coalesce({YEARS}, (SELECT quantile_cont({YEARS}, 0.5) FROM listings_clean), 0)
  AS host_experience_years FROM listings_clean
"""
BLOCKS["price_edges"] = "SELECT " + ", ".join(
    f"CAST(quantile_cont(CAST(price AS DOUBLE), {p}) AS DECIMAL(18,6)) AS q{i}"
    for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))
) + " FROM listings_clean"
ROOMS = "greatest(coalesce(bedrooms, 1), 1)"
BLOCKS["room_prices"] = f"""
SELECT neighbourhood_cleansed AS name,
  CAST(quantile_cont(CAST(price AS DOUBLE) / {ROOMS}, 0.5) AS DECIMAL(18,6)) AS per_room
FROM listings_clean WHERE neighbourhood_cleansed IS NOT NULL GROUP BY 1
"""
TIER = """CASE WHEN host_experience_years <= -0.01 THEN NULL
  WHEN host_experience_years <= 1 THEN 'New (<1yr)'
  WHEN host_experience_years <= 3 THEN 'Growing (1-3yr)'
  WHEN host_experience_years <= 6 THEN 'Established (3-6yr)'
  WHEN host_experience_years <= 100 THEN 'Veteran (6yr+)' END"""
SUB = [
    "review_scores_cleanliness",
    "review_scores_checkin",
    "review_scores_communication",
    "review_scores_location",
    "review_scores_value",
]
COMPOSITE = (
    "CAST("
    + even(
        "(0 + "
        + " + ".join(f"coalesce({c}, 0)" for c in SUB)
        + ") / nullif("
        + " + ".join(f"({c} IS NOT NULL)::INT" for c in SUB)
        + ", 0)"
    )
    + " AS DECIMAL(3,2))"
)
BLOCKS["features"] = f"""
SELECT l.*, host_experience_years, {TIER} AS host_experience_tier,
  CASE WHEN price <= q1 THEN 'Budget' WHEN price <= q2 THEN 'Mid-Range'
       WHEN price <= q3 THEN 'Premium' WHEN price > q3 THEN 'Luxury' END AS price_category,
  date_diff('day', first_review, {AS_OF}) AS listing_age_days,
  date_diff('day', last_review, {AS_OF}) AS days_since_last_review,
  coalesce(date_diff('day', last_review, {AS_OF}) > 365, false) AS is_stale_listing,
  {COMPOSITE} AS review_score_composite,
  CASE WHEN amenities IS NULL OR amenities IN ('', 'nan') THEN 0
       ELSE len(string_split(trim(amenities, '[]'), ',')) END AS amenity_count,
  {ROOMS} AS bedrooms_for_valuation,
  per_room AS neighbourhood_median_price_per_bedroom,
  CAST({even("per_room * CAST(" + ROOMS + " AS DECIMAL(6,1)) * 250", 0)} AS DECIMAL(18,2))
    AS estimated_property_value,
  true AS is_synthetic_valuation
FROM listings_clean l JOIN experience USING (id) CROSS JOIN price_edges
LEFT JOIN room_prices ON name = neighbourhood_cleansed
"""
BLOCKS["master"] = f"""
SELECT *, CASE WHEN pricing_gap > 20 THEN 'Possibly Overpriced'
               WHEN pricing_gap < -20 THEN 'Possibly Underpriced'
               ELSE 'Well-Priced' END AS pricing_signal
FROM (SELECT f.*, k.* EXCLUDE (id),
        CAST(CASE WHEN estimated_property_value > 0
             THEN {even(div("revenue_estimate", "estimated_property_value") + " * 100")} END
             AS DECIMAL(12,2)) AS estimated_annual_roi_pct,
        CAST({even("price - adr")} AS DECIMAL(12,2)) AS pricing_gap
      FROM features f LEFT JOIN kpis k ON k.id = f.id)
"""
BLOCKS["neighbourhoods"] = """
SELECT row_number() OVER (ORDER BY name NULLS LAST) AS neighbourhood_id,
  name AS neighbourhood_name, grp AS neighbourhood_group
FROM (SELECT neighbourhood_cleansed AS name, arg_min(neighbourhood_group_cleansed, id) AS grp
      FROM master GROUP BY 1)
"""
BLOCKS["hosts"] = """
SELECT host_id, host_since, CAST(host_is_superhost AS INTEGER) AS is_superhost,
  CAST(host_response_rate AS DECIMAL(5,2)) AS response_rate_pct,
  host_response_time AS response_time,
  CAST(coalesce(host_identity_verified, false) AS INTEGER) AS identity_verified,
  host_total_listings_count AS total_listings_count,
  CAST(host_experience_years AS DECIMAL(4,1)) AS experience_years,
  host_experience_tier AS experience_tier
FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY id) AS rn FROM master)
WHERE rn = 1
"""
BLOCKS["listings"] = """
SELECT id AS listing_id, host_id, neighbourhood_id, property_type, room_type, accommodates,
  CAST(bedrooms AS DECIMAL(3,1)) AS bedrooms, CAST(beds AS DECIMAL(3,1)) AS beds,
  CAST(bathrooms AS DECIMAL(3,1)) AS bathrooms, amenity_count,
  CAST(price AS DECIMAL(10,2)) AS base_price, price_category, minimum_nights, maximum_nights,
  CAST(coalesce(instant_bookable, false) AS INTEGER) AS instant_bookable,
  first_review AS first_review_date, last_review AS last_review_date,
  CAST(is_stale_listing AS INTEGER) AS is_stale_listing
FROM master LEFT JOIN neighbourhoods
  ON neighbourhood_name IS NOT DISTINCT FROM neighbourhood_cleansed
"""
BLOCKS["listing_performance"] = f"""
SELECT id AS listing_id, total_nights_tracked, booked_nights, occupancy_rate,
  CAST(revenue_estimate AS DECIMAL(14,2)) AS revenue_estimate,
  CAST(adr AS DECIMAL(10,2)) AS adr, CAST(revpar AS DECIMAL(10,2)) AS revpar,
  CAST({r("avg_open_listing_price")} AS DECIMAL(10,2)) AS avg_open_listing_price,
  CAST(pricing_gap AS DECIMAL(10,2)) AS pricing_gap, pricing_signal
FROM master WHERE total_nights_tracked IS NOT NULL
"""
BLOCKS["listing_valuation"] = """
SELECT id AS listing_id, CAST(estimated_property_value AS DECIMAL(14,2)) AS estimated_property_value,
  estimated_annual_roi_pct, 1 AS is_synthetic_valuation, 250 AS valuation_multiplier FROM master
"""
BLOCKS["calendar_daily"] = """
SELECT listing_id, date AS calendar_date, CAST(available AS INTEGER) AS is_available,
  CAST(price AS DECIMAL(10,2)) AS price FROM calendar_clean
"""
BLOCKS["reviews"] = """
SELECT id AS review_id, listing_id, reviewer_id, reviewer_name, date AS review_date, comments
FROM reviews_clean
"""
_score = lambda c: f"CAST({r(c)} AS DECIMAL(3,2))"
BLOCKS["review_scores"] = f"""
SELECT id AS listing_id, {_score(even("review_scores_rating / CAST(20 AS DOUBLE)"))} AS rating,
  {_score("review_scores_cleanliness")} AS cleanliness, {_score("review_scores_checkin")} AS checkin,
  {_score("review_scores_communication")} AS communication,
  {_score("review_scores_location")} AS location_score,
  {_score("review_scores_value")} AS value_score,
  review_score_composite AS composite_score
FROM master
"""
BLOCKS["listing_rows"] = """
SELECT * FROM listings JOIN listing_performance USING (listing_id)
LEFT JOIN review_scores USING (listing_id)
"""
BLOCKS["placed_listings"] = """
SELECT * FROM listing_rows JOIN neighbourhoods USING (neighbourhood_id)
"""
BLOCKS["hosted_listings"] = """
SELECT * FROM listing_rows JOIN hosts USING (host_id)
"""
BLOCKS["dim_date"] = """
SELECT strftime(d, '%Y%m%d') AS DateKey, d AS Date, CAST(year(d) AS BIGINT) AS Year,
  CAST(quarter(d) AS BIGINT) AS Quarter, CAST(month(d) AS BIGINT) AS MonthNum,
  monthname(d) AS MonthName, strftime(d, '%Y-%m') AS YearMonth, dayname(d) AS DayName,
  isodow(d) >= 6 AS IsWeekend
FROM (SELECT CAST(unnest(generate_series(min(calendar_date) - INTERVAL 7 DAY,
        max(calendar_date) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM calendar_daily)
"""
BLOCKS["dim_neighbourhood"] = """
SELECT neighbourhood_id AS NeighbourhoodKey, neighbourhood_name AS NeighbourhoodName,
  neighbourhood_group AS NeighbourhoodGroup FROM neighbourhoods
"""
BLOCKS["dim_host"] = """
SELECT host_id AS HostKey, host_since AS HostSince, is_superhost AS IsSuperhost,
  response_rate_pct AS ResponseRatePct, total_listings_count AS TotalListingsCount,
  experience_years AS ExperienceYears, experience_tier AS ExperienceTier FROM hosts
"""
BLOCKS["dim_listing"] = """
SELECT listing_id AS ListingKey, property_type AS PropertyType, room_type AS RoomType,
  accommodates AS Accommodates, bedrooms AS Bedrooms, beds AS Beds, bathrooms AS Bathrooms,
  amenity_count AS AmenityCount, base_price AS BasePrice, price_category AS PriceCategory,
  minimum_nights AS MinimumNights, maximum_nights AS MaximumNights,
  instant_bookable AS InstantBookable, first_review_date AS FirstReviewDate,
  last_review_date AS LastReviewDate, is_stale_listing AS IsStaleListing,
  CASE price_category WHEN 'Budget' THEN 1 WHEN 'Mid-Range' THEN 2 WHEN 'Premium' THEN 3
    WHEN 'Luxury' THEN 4 ELSE 0 END AS PriceCategorySort
FROM listings
"""
BLOCKS["fact_performance"] = """
SELECT p.listing_id AS ListingKey, total_nights_tracked AS TotalNightsTracked,
  booked_nights AS BookedNights, occupancy_rate AS OccupancyRate,
  revenue_estimate AS RevenueEstimate, adr AS ADR, revpar AS RevPAR,
  avg_open_listing_price AS AvgOpenListingPrice, pricing_gap AS PricingGap,
  pricing_signal AS PricingSignal, estimated_property_value AS EstimatedPropertyValue,
  estimated_annual_roi_pct AS EstimatedAnnualROIPct,
  is_synthetic_valuation AS IsSyntheticValuation, host_id AS HostKey,
  neighbourhood_id AS NeighbourhoodKey
FROM listing_performance p LEFT JOIN listing_valuation v ON v.listing_id = p.listing_id
LEFT JOIN listings l ON l.listing_id = p.listing_id
"""
BLOCKS["fact_calendar"] = """
SELECT c.listing_id AS ListingKey, calendar_date AS Date, is_available AS IsAvailable,
  price AS Price, host_id AS HostKey, neighbourhood_id AS NeighbourhoodKey,
  strftime(calendar_date, '%Y%m%d') AS DateKey, 1 - is_available AS IsBooked,
  CASE WHEN is_available = 0 THEN price ELSE 0 END AS BookedRevenue,
  strftime(calendar_date, '%Y-%m') AS YearMonth
FROM calendar_daily c LEFT JOIN listings l ON l.listing_id = c.listing_id
"""
BLOCKS["fact_reviews"] = """
SELECT review_id AS ReviewKey, r.listing_id AS ListingKey, review_date AS ReviewDate,
  host_id AS HostKey, neighbourhood_id AS NeighbourhoodKey,
  strftime(review_date, '%Y%m%d') AS ReviewDateKey, 1 AS ReviewCount
FROM reviews r LEFT JOIN listings l ON l.listing_id = r.listing_id
"""
BLOCKS["fact_review_scores"] = """
SELECT s.listing_id AS ListingKey, rating AS Rating, cleanliness AS Cleanliness,
  checkin AS Checkin, communication AS Communication, location_score AS LocationScore,
  value_score AS ValueScore, composite_score AS CompositeScore, host_id AS HostKey,
  neighbourhood_id AS NeighbourhoodKey
FROM review_scores s LEFT JOIN listings l ON l.listing_id = s.listing_id
"""
BLOCKS["nights"] = """
SELECT f.*, n.NeighbourhoodName, n.NeighbourhoodGroup, h.IsSuperhost, h.ExperienceTier,
  l.RoomType, l.PropertyType, l.PriceCategory, d.Year, d.Quarter, d.MonthNum, d.MonthName,
  d.DayName, d.IsWeekend
FROM fact_calendar f
LEFT JOIN dim_neighbourhood n ON n.NeighbourhoodKey = f.NeighbourhoodKey
LEFT JOIN dim_host h ON h.HostKey = f.HostKey
LEFT JOIN dim_listing l ON l.ListingKey = f.ListingKey
LEFT JOIN dim_date d ON d.DateKey = f.DateKey
"""
BLOCKS["month_revenue"] = """
SELECT YearMonth AS yr_month, sum(BookedRevenue) AS total_revenue, sum(IsBooked) AS booked,
  count(*) AS nights, CAST(left(YearMonth, 4) AS INT) * 12 + CAST(right(YearMonth, 2) AS INT) AS m
FROM fact_calendar GROUP BY 1
"""

_WORD = re.compile(r"\b[a-z_]+\b")


def _uses(sql: str) -> list[str]:
    """Blocks read by a query: names after FROM, JOIN or a comma in a FROM list."""
    return [n for n in BLOCKS if re.search(rf"(?:FROM|JOIN|,)\s+{n}\b", sql)]


def with_blocks(sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str, trail: tuple = ()) -> None:
        if name in ordered or name in trail:
            return
        for other in _uses(BLOCKS[name]):
            if other != name:
                visit(other, (*trail, name))
        ordered.append(name)

    for name in _uses(sql):
        visit(name)
    if not ordered:
        return sql
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {blocks},\n{body[5:]}"
    return f"WITH {blocks}\n{body}"
