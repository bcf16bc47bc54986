"""SQL for the interactive summary and the insight pack."""

from __future__ import annotations

from oracle.ctes import avg, div
from oracle.library import d, n

STALE = "coalesce(is_stale_listing, false)"
ACTION = f"(pricing_signal <> 'Well-Priced' OR {STALE})"
TEXT = (
    "lower(CAST(id AS VARCHAR) || ' ' || coalesce(property_type, '') || ' ' || "
    "CAST(host_id AS VARCHAR) || ' ' || coalesce(neighbourhood_cleansed, ''))"
)


def kpis(where: str = "true") -> str:
    return f"""SELECT {d("coalesce(sum(revenue_estimate), 0)", "revenue")},
  {n("coalesce(sum(booked_nights), 0)", "booked")},
  {n("coalesce(sum(total_nights_tracked), 0)", "tracked")}, {n("count(*)", "listings")},
  coalesce({div("sum(booked_nights)", "sum(total_nights_tracked)")}, 0) AS occupancy,
  coalesce({div("sum(revenue_estimate)", "sum(total_nights_tracked)")}, 0) AS revpar,
  {n(f"count(*) FILTER (WHERE {ACTION})", "actions")}
FROM master WHERE {where}"""


def groups(where: str = "true") -> str:
    return f"""SELECT coalesce(nullif(neighbourhood_cleansed, ''), 'Unspecified') AS name,
  {n("count(*)", "listings")}, {d("coalesce(sum(revenue_estimate), 0)", "revenue")},
  {n("coalesce(sum(booked_nights), 0)", "booked")},
  {n("coalesce(sum(total_nights_tracked), 0)", "tracked")},
  coalesce({div("sum(booked_nights)", "sum(total_nights_tracked)")}, 0) AS occupancy,
  coalesce({div("sum(revenue_estimate)", "sum(total_nights_tracked)")}, 0) AS revpar,
  {div("sum(coalesce(estimated_annual_roi_pct, 0))", "count(*)")} AS roi
FROM master WHERE {where} GROUP BY 1"""


def host_group(label: str, test: str) -> str:
    f = f"FILTER (WHERE {test})"
    occ = div(f"sum(booked_nights) {f}", f"sum(total_nights_tracked) {f}")
    return f"SELECT '{label}' AS host_group, coalesce({occ}, 0) AS occupancy FROM master"


AREAS = f"""SELECT neighbourhood_cleansed, count(id) AS listings,
  coalesce(sum(revenue_estimate), 0) AS revenue, sum(booked_nights) AS booked,
  sum(total_nights_tracked) AS tracked, {avg("estimated_annual_roi_pct")} AS avg_roi,
  {avg("review_score_composite")} AS avg_review FROM master GROUP BY 1"""
TOTAL = "(SELECT sum(revenue_estimate) FROM master)"
ORDERED = "ORDER BY revenue DESC, neighbourhood_cleansed NULLS LAST"
MONTHS = "SELECT year_month, sum(revenue) AS r FROM monthly_agg GROUP BY 1"


def gap(a: str, b: str) -> str:
    def part(test: str) -> str:
        f = f"FILTER (WHERE {test})"
        return div(f"sum({a}) {f}", f"sum({b}) {f}")

    return f"{part('host_is_superhost')} / {part('NOT host_is_superhost')} - 1"


REVPAR_GAP = gap("revenue_estimate", "total_nights_tracked")
OCC_GAP = gap("booked_nights", "total_nights_tracked")
SCORE = "review_score_composite"


def score(test: str) -> str:
    f = f"FILTER (WHERE {test})"
    return div(f"sum({SCORE}) {f}", f"count({SCORE}) {f}")


def by_tier(columns: str, where: str) -> str:
    tier = "coalesce(host_experience_tier, '(none)')"
    return " UNION ALL ".join(
        f"SELECT {t} AS experience_tier, {columns} FROM master WHERE {where} GROUP BY 1"
        for t in (tier, "'All'")
    )


SQL = {
    "w01_filter_choices": """
SELECT DISTINCT 'neighbourhood' AS kind, neighbourhood_cleansed AS value FROM master
WHERE neighbourhood_cleansed <> ''
UNION ALL SELECT DISTINCT 'room type', room_type FROM master WHERE room_type <> ''
UNION ALL SELECT 'first month', min(year_month) FROM monthly_agg
UNION ALL SELECT 'last month', max(year_month) FROM monthly_agg""",
    "w02_filtered_rows": f"""
SELECT id, host_id, property_type, neighbourhood_cleansed, room_type FROM master
WHERE neighbourhood_cleansed = 'NATION_9' AND room_type = 'Private room'
  AND contains({TEXT}, 'econ')""",
    "w02_text_search": f"""
SELECT id, host_id, property_type FROM master WHERE contains({TEXT}, 'nation_1')""",
    "w03_kpi_summary": kpis(),
    "w03_kpi_summary_filtered": kpis(f"room_type = 'Hotel room' AND contains({TEXT}, 'large')"),
    "w03_kpi_summary_empty": kpis(f"contains({TEXT}, 'no such listing')"),
    "w04_monthly_series": f"SELECT year_month, {d('sum(revenue)', 'revenue')} "
    "FROM monthly_agg GROUP BY 1",
    "w05_room_mix": f"SELECT room_type, {n('count(*)', 'listings')}, "
    f"{div('count(*)', '(SELECT count(*) FROM master)')} AS share FROM master GROUP BY 1",
    "w06_market_groups": groups(),
    "w07_top_markets": f"SELECT * FROM ({groups()}) ORDER BY revenue DESC, name LIMIT 6",
    "w07_market_table": groups(),
    "w07_market_table_entire_homes": groups("room_type = 'Entire home/apt'"),
    "w08_host_comparison": host_group("Superhost", "coalesce(host_is_superhost, false)")
    + " UNION ALL "
    + host_group("Non-superhost", "NOT coalesce(host_is_superhost, false)"),
    "w09_action_queue": f"""
SELECT id, neighbourhood_cleansed, {d("price", "price")}, {d("adr", "adr")},
  {d("pricing_gap", "pricing_gap")},
  CASE WHEN pricing_signal <> 'Well-Priced' THEN pricing_signal ELSE 'Stale review' END AS status
FROM master WHERE {ACTION} ORDER BY abs(coalesce(master.pricing_gap, 0)) DESC, id LIMIT 18""",
    "i01_market_totals": f"""
SELECT {n("count(*)", "listings")}, {d("sum(revenue_estimate)", "revenue")},
  {n("sum(booked_nights)", "booked")}, {n("sum(total_nights_tracked)", "tracked")},
  {div("sum(booked_nights)", "sum(total_nights_tracked)")} AS occupancy,
  {div("sum(revenue_estimate)", "sum(total_nights_tracked)")} AS revpar FROM master""",
    "i02_neighbourhood_rollup": f"""
SELECT neighbourhood_cleansed, {n("listings", "listings")}, {d("revenue", "revenue")},
  {n("booked", "booked")}, {n("tracked", "tracked")}, avg_roi, avg_review,
  {div("booked", "tracked")} AS occupancy, {div("revenue", TOTAL)} AS revenue_share
FROM ({AREAS})""",
    "i03_concentration": f"""
SELECT {div("sum(revenue)", TOTAL)} AS top_share,
  first(neighbourhood_cleansed ORDER BY revenue DESC, neighbourhood_cleansed NULLS LAST) AS leader
FROM (SELECT * FROM ({AREAS}) {ORDERED} LIMIT 3)""",
    "i04_peak_month": f"""
SELECT (SELECT year_month FROM ({MONTHS}) ORDER BY r DESC, 1 LIMIT 1) AS peak_month,
  (SELECT year_month FROM ({MONTHS}) ORDER BY r, 1 LIMIT 1) AS low_month""",
    "i05_superhost_gap": f"SELECT {REVPAR_GAP} AS revpar_gap FROM master",
    "i06_stale_count": f"SELECT {n('count(*) FILTER (WHERE coalesce(is_stale_listing, true))', 'stale_listings')} FROM master",  # noqa: E501
    "i07_pricing_flags": "SELECT CAST(count(*) FILTER (WHERE pricing_signal <> 'Well-Priced') "
    "AS BIGINT) AS pricing_flags FROM master",
    "i08_best_roi": f"SELECT neighbourhood_cleansed AS best_roi_area, avg_roi FROM ({AREAS}) "
    "WHERE avg_roi IS NOT NULL ORDER BY avg_roi DESC, 1 NULLS LAST LIMIT 1",
    "i10_top_share": f"""
SELECT neighbourhood_cleansed, {n("row_number() OVER w", "revenue_rank")},
  {div("sum(revenue) OVER w", TOTAL)} AS revenue_share,
  {div("sum(listings) OVER w", "(SELECT count(*) FROM master)")} AS listing_share
FROM ({AREAS}) WINDOW w AS ({ORDERED} ROWS UNBOUNDED PRECEDING) {ORDERED} LIMIT 3""",
    "i11_under_supplied": f"""
SELECT * FROM (SELECT neighbourhood_cleansed, {n("listings", "listings")}, revpar,
    percent_rank() OVER (ORDER BY revpar) AS revpar_rank,
    percent_rank() OVER (ORDER BY listings) AS supply_rank
  FROM (SELECT neighbourhood_cleansed, listings, {div("revenue", "tracked")} AS revpar
        FROM ({AREAS}) WHERE neighbourhood_cleansed IS NOT NULL))
WHERE revpar_rank >= 0.75 AND supply_rank <= 0.5""",
    "i12_growth_before_dip": f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY yr_month) AS pos,
             lag(total_revenue) OVER (ORDER BY yr_month) AS prior FROM month_revenue),
flat AS (SELECT *, max(pos) FILTER (WHERE prior IS NULL OR total_revenue <= prior)
           OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_flat
         FROM s)
SELECT yr_month, {n("pos - 1 - last_flat", "months_of_growth")},
  {div("(total_revenue - prior)", "prior")} AS change
FROM flat WHERE total_revenue < prior AND pos - 1 - last_flat > 0""",
    "i13_fragile_leaders": f"""
SELECT *, {n("rank() OVER (ORDER BY revpar DESC)", "revpar_rank")},
  {n("rank() OVER (ORDER BY avg_review NULLS LAST)", "lowest_score_rank")}
FROM (SELECT neighbourhood_cleansed, {div("revenue", "tracked")} AS revpar, avg_review
      FROM ({AREAS}) {ORDERED} LIMIT 10)""",
    "i14_underpriced_share": by_tier(
        f"{n('count(*)', 'flagged')}, "
        "CAST(count(*) FILTER (WHERE pricing_signal = 'Possibly Underpriced') AS BIGINT) "
        "AS underpriced, "
        + div("count(*) FILTER (WHERE pricing_signal = 'Possibly Underpriced')", "count(*)")
        + " AS underpriced_share",
        "pricing_signal <> 'Well-Priced'",
    ),
    "i15_superhost_gaps": f"SELECT {OCC_GAP} AS occupancy_gap, {REVPAR_GAP} AS revpar_gap, "
    f"{score('host_is_superhost')} - {score('NOT host_is_superhost')} AS score_gap FROM master",
    "i16_stale_share": by_tier(
        f"{n('count(*)', 'listings')}, "
        "CAST(count(*) FILTER (WHERE is_stale_listing) AS BIGINT) AS stale, "
        + div("count(*) FILTER (WHERE is_stale_listing)", "count(*)")
        + " AS stale_share",
        "true",
    ),
    "i16_win_back": f"SELECT id, host_id, host_experience_tier, "
    f"{n('listing_age_days', 'listing_age_days')}, "
    f"{n('days_since_last_review', 'days_since_last_review')} FROM master "
    "WHERE is_stale_listing AND master.listing_age_days < 730",
    "i17_price_lag": f"""
WITH rates AS (SELECT year_month, {div("sum(nights_booked)", "sum(nights_tracked)")} AS occ,
                 {div("sum(revenue)", "sum(nights_booked)")} AS adr FROM monthly_agg GROUP BY 1),
moved AS (SELECT year_month, {div("(occ - lag(occ) OVER w)", "lag(occ) OVER w")}
            AS occupancy_change, {div("(adr - lag(adr) OVER w)", "lag(adr) OVER w")} AS adr_change
          FROM rates WINDOW w AS (ORDER BY year_month))
SELECT * FROM moved WHERE occupancy_change < 0 AND occupancy_change < adr_change""",
    "i18_room_mix": f"SELECT neighbourhood_cleansed, room_type, {n('count(*)', 'listings')}, "
    f"{div('sum(revenue_estimate)', 'sum(total_nights_tracked)')} AS revpar "
    "FROM master GROUP BY 1, 2",
}
