"""SQL for the measures."""

from __future__ import annotations

from oracle.ctes import avg, div
from oracle.library import d, n

AREA = "NeighbourhoodName"
PERF = (
    "fact_performance f LEFT JOIN dim_neighbourhood n ON n.NeighbourhoodKey = f.NeighbourhoodKey "
    "LEFT JOIN dim_listing l ON l.ListingKey = f.ListingKey"
)
SCORES = (
    "fact_review_scores f "
    "LEFT JOIN dim_neighbourhood n ON n.NeighbourhoodKey = f.NeighbourhoodKey"
)
REVIEWS = "fact_reviews f LEFT JOIN dim_date d ON d.DateKey = f.ReviewDateKey"
REV = "sum(BookedRevenue)"
OCC = div("sum(IsBooked)", "count(*)")
ADR = div(REV, "sum(IsBooked)")
REVPAR = div(REV, "count(*)")


def distinct(condition: str) -> str:
    return f"CAST(count(DISTINCT CASE WHEN {condition} THEN f.ListingKey END) AS BIGINT)"


FLAGGED = distinct("PricingSignal <> 'Well-Priced'")
OVER = distinct("PricingSignal = 'Possibly Overpriced'")
UNDER = distinct("PricingSignal = 'Possibly Underpriced'")


def growth(a: str, b: str) -> str:
    return div(f"({a} - {b})", b)


RANKED = """
SELECT l.ListingKey, CAST(coalesce(sum(BookedRevenue), 0) AS DOUBLE) AS total_revenue
FROM dim_listing l LEFT JOIN fact_calendar f ON f.ListingKey = l.ListingKey {where}
GROUP BY 1
"""
AREA_RANK = f"""
SELECT n.NeighbourhoodName, {d("coalesce(sum(BookedRevenue), 0)", "total_revenue")},
  {n("dense_rank() OVER (ORDER BY coalesce(sum(BookedRevenue), 0) DESC)", "revenue_rank")}
FROM dim_neighbourhood n LEFT JOIN fact_calendar f ON f.NeighbourhoodKey = n.NeighbourhoodKey
GROUP BY n.NeighbourhoodKey, 1
"""
AREA_MONTHS = """
SELECT NeighbourhoodName, YearMonth, sum(BookedRevenue) AS rev,
  CAST(left(YearMonth, 4) AS INT) * 12 + CAST(right(YearMonth, 2) AS INT) AS m
FROM nights GROUP BY 1, 2
"""


def top_ten(where: str) -> str:
    return f"""SELECT *, CAST(revenue_rank <= 10 AS BIGINT) AS is_top_10
      FROM (SELECT ListingKey, total_revenue,
        {n("dense_rank() OVER (ORDER BY total_revenue DESC)", "revenue_rank")}
        FROM ({RANKED.format(where=where)}))"""


def running(where: str) -> str:
    return f"""SELECT yr_month AS YearMonth,
      {d("sum(total_revenue) OVER (ORDER BY m)", "cumulative_revenue")}
      FROM month_revenue WHERE {where}"""


def by_area(expr: str, name: str, source: str = "nights") -> str:
    return f"SELECT NeighbourhoodName, {expr} AS {name} FROM {source} GROUP BY 1"


SQL = {
    "m01_total_revenue": f"SELECT YearMonth, NeighbourhoodName, {d(REV, 'total_revenue')} "
    "FROM nights GROUP BY 1, 2",
    "m02_total_listings": f"SELECT RoomType, {n('count(DISTINCT ListingKey)', 'total_listings')} "
    "FROM dim_listing GROUP BY 1",
    "m03_avg_occupancy": by_area(OCC, "avg_occupancy"),
    "m04_adr": f"SELECT YearMonth, {ADR} AS adr FROM nights GROUP BY 1",
    "m05_revpar": f"SELECT DayName, {REVPAR} AS revpar FROM nights GROUP BY 1",
    "m06_mom_growth": f"""SELECT a.yr_month AS YearMonth,
      {growth("a.total_revenue", "b.total_revenue")} AS revenue_mom_growth
      FROM month_revenue a LEFT JOIN month_revenue b ON b.m = a.m - 1""",
    "m07_yoy_growth": f"""SELECT a.yr_month AS YearMonth,
      {growth("a.total_revenue", "b.total_revenue")} AS revenue_yoy_growth
      FROM month_revenue a LEFT JOIN month_revenue b ON b.m = a.m - 12""",
    "m08_trailing_average": f"""WITH am AS ({AREA_MONTHS})
      SELECT a.YearMonth, a.NeighbourhoodName,
        CAST(sum(b.rev) AS DOUBLE) / CAST(3 AS DOUBLE) AS revenue_3m_avg
      FROM am a JOIN am b ON b.NeighbourhoodName IS NOT DISTINCT FROM a.NeighbourhoodName
        AND b.m BETWEEN a.m - 2 AND a.m GROUP BY 1, 2""",
    "m09_listing_revenue_rank": f"""SELECT ListingKey, total_revenue,
      {n("dense_rank() OVER (ORDER BY total_revenue DESC)", "revenue_rank")}
      FROM ({RANKED.format(where="")})""",
    "m10_neighbourhood_rank": AREA_RANK,
    "m11_top_ten_listings": top_ten(""),
    "m11_top_ten_private_rooms": top_ten("WHERE RoomType = 'Private room'"),
    "m12_cumulative_revenue": running("true"),
    "m12_cumulative_revenue_since_1996": running("yr_month >= '1996-01'"),
    "m13_pricing_opportunities": by_area(FLAGGED, "pricing_opportunities", PERF),
    "m14_superhost_share": by_area(
        div("sum(BookedRevenue) FILTER (WHERE IsSuperhost = 1)", REV), "superhost_revenue_share"
    ),
    "m15_avg_estimated_roi": by_area(avg("EstimatedAnnualROIPct"), "avg_estimated_roi", PERF),
    "m16_overpriced_listings": by_area(OVER, "overpriced_listings", PERF),
    "m17_underpriced_listings": by_area(UNDER, "underpriced_listings", PERF),
    "m18_avg_property_value": f"SELECT RoomType, {avg('EstimatedPropertyValue')} AS "
    f"avg_property_value FROM {PERF} GROUP BY 1",
    "m19_total_property_value": "SELECT RoomType, CAST(sum(EstimatedPropertyValue) AS DOUBLE) AS "
    f"total_property_value FROM {PERF} GROUP BY 1",
    "m20_stale_listings": "SELECT PriceCategory, CAST(count(DISTINCT CASE WHEN IsStaleListing = 1 "
    "THEN ListingKey END) AS BIGINT) AS stale_listings FROM dim_listing GROUP BY 1",
    "m21_review_count": f"SELECT YearMonth, {n('sum(ReviewCount)', 'review_count')} "
    f"FROM {REVIEWS} GROUP BY 1",
    "m22_avg_rating": by_area(avg("Rating"), "avg_rating", SCORES),
    "m23_avg_cleanliness": by_area(avg("Cleanliness"), "avg_cleanliness", SCORES),
    "m24_avg_checkin": by_area(avg("Checkin"), "avg_checkin", SCORES),
    "m25_avg_communication": by_area(avg("Communication"), "avg_communication", SCORES),
    "m26_avg_location": by_area(avg("LocationScore"), "avg_location", SCORES),
    "m27_avg_value": by_area(avg("ValueScore"), "avg_value", SCORES),
    "m28_metric_selector": " UNION ALL ".join(
        f"SELECT NeighbourhoodName, '{name}' AS metric, CAST({expr} AS DOUBLE) AS value "
        "FROM nights GROUP BY 1"
        for name, expr in (
            ("total_revenue", REV),
            ("revpar", REVPAR),
            ("adr", ADR),
            ("avg_occupancy", OCC),
        )
    ),
    "m29_granularity": f"""SELECT coalesce(a.Quarter, b.Quarter) AS Quarter, total_revenue,
      review_count FROM
      (SELECT Quarter, {d(REV, "total_revenue")} FROM nights GROUP BY 1) a
      FULL JOIN (SELECT Quarter, {n("sum(ReviewCount)", "review_count")} FROM {REVIEWS} GROUP BY 1) b
      ON a.Quarter IS NOT DISTINCT FROM b.Quarter""",
}
