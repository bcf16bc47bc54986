"""SQL for the report views."""

from __future__ import annotations

from oracle import library
from oracle.ctes import avg, div
from oracle.library import d, n
from oracle.measures import (
    ADR,
    AREA_RANK,
    FLAGGED,
    OCC,
    OVER,
    PERF,
    REV,
    REVIEWS,
    REVPAR,
    SCORES,
    UNDER,
    growth,
)

ALL_LISTINGS = n("(SELECT count(*) FROM dim_listing)", "total_listings")


def cards(night_filter: str = "true", area_filter: str = "true") -> str:
    return f"""
SELECT (SELECT {REV}::DOUBLE FROM nights WHERE {night_filter}) AS total_revenue, {ALL_LISTINGS},
  (SELECT {OCC} FROM nights WHERE {night_filter}) AS avg_occupancy,
  (SELECT {REVPAR} FROM nights WHERE {night_filter}) AS revpar,
  (SELECT {FLAGGED} FROM {PERF} WHERE {area_filter}) AS pricing_opportunities"""


def trend(where: str) -> str:
    return f"""WITH am AS (
  SELECT YearMonth, sum(BookedRevenue) AS rev,
    CAST(left(YearMonth, 4) AS INT) * 12 + CAST(right(YearMonth, 2) AS INT) AS m
  FROM nights WHERE {where} GROUP BY 1)
SELECT a.YearMonth, CAST(a.rev AS DOUBLE) AS total_revenue,
  CAST(sum(b.rev) AS DOUBLE) / CAST(3 AS DOUBLE) AS revenue_3m_avg
FROM am a JOIN am b ON b.m BETWEEN a.m - 2 AND a.m GROUP BY 1, a.rev"""


def combo(axis: str, shown: str = "true", rows: str = "true") -> str:
    """Revenue, growth on the previous month(s) and the running total along a date column."""
    return f"""WITH rev AS (
  SELECT CAST(left(YearMonth, 4) AS INT) * 12 + CAST(right(YearMonth, 2) AS INT) AS m,
    sum(BookedRevenue) AS r FROM nights WHERE {rows} GROUP BY 1),
spine AS (SELECT DISTINCT {axis} AS axis,
    CAST(left(YearMonth, 4) AS INT) * 12 + CAST(right(YearMonth, 2) AS INT) AS m
  FROM dim_date WHERE {shown}),
joined AS (SELECT axis, spine.m, a.r AS cur, b.r AS prior,
    sum(a.r) OVER (ORDER BY spine.m) AS running
  FROM spine LEFT JOIN rev a ON a.m = spine.m LEFT JOIN rev b ON b.m = spine.m - 1)
SELECT axis AS {axis}, CAST(sum(cur) AS DOUBLE) AS total_revenue,
  {growth("sum(cur)", "sum(prior)")} AS revenue_mom_growth,
  CAST(max(running) FILTER (WHERE cur IS NOT NULL) AS DOUBLE) AS cumulative_revenue
FROM joined GROUP BY axis HAVING sum(cur) IS NOT NULL"""


def scatter(where: str = "true") -> str:
    return f"""SELECT ListingKey, PriceCategory, {ADR} AS adr, {OCC} AS avg_occupancy,
  {d(REV, "total_revenue")} FROM nights WHERE {where} GROUP BY 1, 2"""


def hosts(where: str = "true") -> str:
    return f"""SELECT a.HostKey, avg_occupancy, total_revenue, avg_composite, ExperienceTier
FROM (SELECT HostKey, {OCC} AS avg_occupancy, {d(REV, "total_revenue")} FROM nights
      WHERE HostKey IS NOT NULL GROUP BY 1) a
JOIN dim_host h ON h.HostKey = a.HostKey
LEFT JOIN (SELECT HostKey, {avg("CompositeScore")} AS avg_composite FROM fact_review_scores
           GROUP BY 1) s ON s.HostKey = a.HostKey
WHERE {where}"""


AREAS = "NeighbourhoodName IN ('NATION_1', 'NATION_2', 'NATION_9')"
QUARTERS = ", ".join(
    f"CAST(sum(BookedRevenue) FILTER (WHERE Quarter = {q}) AS DOUBLE) AS q{q}" for q in range(1, 5)
)
BUCKET = """CASE WHEN CompositeScore >= 4.8 THEN '4.8 - 5.0 (Excellent)'
  WHEN CompositeScore >= 4.5 THEN '4.5 - 4.8 (Very Good)'
  WHEN CompositeScore >= 4.0 THEN '4.0 - 4.5 (Good)' ELSE 'Below 4.0' END"""
PERIOD = f"""{d(REV, "total_revenue")}, {OCC} AS avg_occupancy, {REVPAR} AS revpar FROM nights"""

SQL = {
    "v01_executive_cards": cards(),
    "v02_monthly_trend": trend("true"),
    "v03_listing_map": """SELECT m.id AS ListingKey, latitude, longitude, m.price_category,
      CAST(coalesce(sum(BookedRevenue), 0) AS DOUBLE) AS total_revenue
      FROM master m LEFT JOIN fact_calendar f ON f.ListingKey = m.id GROUP BY 1, 2, 3, 4""",
    "v04_top_neighbourhoods": f"SELECT * FROM ({AREA_RANK}) WHERE revenue_rank <= 5",
    "v05_superhost_split": f"""SELECT CAST(IsSuperhost AS BIGINT) AS IsSuperhost,
      {d(REV, "total_revenue")},
      {div(REV, "(SELECT sum(BookedRevenue) FROM nights)")} AS share FROM nights GROUP BY 1""",
    "v06_period_toggle": f"""
      SELECT 'This Month' AS period, {PERIOD}
      WHERE YearMonth = (SELECT max(YearMonth) FROM nights)
      UNION ALL SELECT 'Year to Date', {PERIOD}
      WHERE left(YearMonth, 4) = (SELECT left(max(YearMonth), 4) FROM nights)""",
    "v07_revenue_combo": combo("YearMonth"),
    "v07_revenue_combo_quarter": combo("Quarter"),
    "v07_revenue_combo_year": combo("Year"),
    "v08_room_quarter_matrix": f"""SELECT CASE WHEN grouping(RoomType) = 1 THEN 'Total'
      ELSE coalesce(RoomType, '(none)') END AS room_type, {QUARTERS}, {d(REV, "total")}
      FROM nights GROUP BY ROLLUP (RoomType)""",
    "v09_adr_occupancy_scatter": scatter(),
    "v10_occupancy_trends": f"SELECT NeighbourhoodName, YearMonth, {OCC} AS avg_occupancy "
    "FROM nights GROUP BY 1, 2",
    "v11_neighbourhood_summary": f"""SELECT a.NeighbourhoodName, avg_occupancy, total_revenue,
      avg_estimated_roi, listing_count, avg_price
      FROM (SELECT NeighbourhoodName, {OCC} AS avg_occupancy, {d(REV, "total_revenue")}
            FROM nights GROUP BY 1) a
      LEFT JOIN (SELECT NeighbourhoodName, {avg("EstimatedAnnualROIPct")} AS avg_estimated_roi,
                   {n("count(DISTINCT f.ListingKey)", "listing_count")},
                   {avg("BasePrice")} AS avg_price FROM {PERF} GROUP BY 1) b
      ON a.NeighbourhoodName IS NOT DISTINCT FROM b.NeighbourhoodName""",
    "v12_drill_neighbourhood": trend("NeighbourhoodName = 'NATION_9'"),
    "v12_drill_host": scatter("HostKey = 7"),
    "v12_drill_listing": trend("ListingKey = 12"),
    "v13_pricing_cards": f"SELECT {FLAGGED} AS pricing_opportunities, {OVER} AS "
    f"overpriced_listings, {UNDER} AS underpriced_listings FROM {PERF}",
    "v13_price_scatter": f"SELECT f.ListingKey, {d('BasePrice', 'BasePrice')}, "
    f"{d('ADR', 'ADR')}, PricingSignal FROM {PERF}",
    "v14_act_first": f"SELECT f.ListingKey, NeighbourhoodName, {d('ADR', 'ADR')}, "
    f"{d('PricingGap', 'PricingGap')}, PricingSignal FROM {PERF} "
    "WHERE PricingSignal <> 'Well-Priced'",
    "v15_occupancy_by_price": f"SELECT PriceCategory, {OCC} AS avg_occupancy FROM nights "
    "GROUP BY 1",
    "v16_host_scatter": hosts(),
    "v17_revenue_by_tier": f"SELECT ExperienceTier, {d(REV, 'total_revenue')} FROM nights "
    "GROUP BY 1",
    "v17_superhost_pair": f"""SELECT CAST(a.IsSuperhost AS BIGINT) AS IsSuperhost, avg_occupancy,
      revpar, avg_composite
      FROM (SELECT IsSuperhost, {OCC} AS avg_occupancy, {REVPAR} AS revpar FROM nights
            WHERE IsSuperhost IS NOT NULL GROUP BY 1) a
      JOIN (SELECT IsSuperhost, {avg("CompositeScore")} AS avg_composite
            FROM fact_review_scores s JOIN dim_host h ON h.HostKey = s.HostKey GROUP BY 1) b
      ON a.IsSuperhost = b.IsSuperhost""",
    "v18_new_hosts": hosts("ExperienceTier = 'New (<1yr)'"),
    "v19_review_volume": f"SELECT YearMonth, {n('sum(ReviewCount)', 'review_count')} "
    f"FROM {REVIEWS} GROUP BY 1",
    "v19_review_volume_year": f"SELECT Year, {n('sum(ReviewCount)', 'review_count')} "
    f"FROM {REVIEWS} GROUP BY 1",
    "v20_revenue_by_score": f"""SELECT {BUCKET} AS review_score_bucket, {d(REV, "total_revenue")}
      FROM nights JOIN fact_review_scores s ON s.ListingKey = nights.ListingKey
      WHERE CompositeScore IS NOT NULL GROUP BY 1""",
    "v21_sub_scores": "SELECT "
    + ", ".join(
        f"{avg(c)} AS {name}"
        for c, name in (
            ("Cleanliness", "avg_cleanliness"),
            ("Checkin", "avg_checkin"),
            ("Communication", "avg_communication"),
            ("LocationScore", "avg_location"),
            ("ValueScore", "avg_value"),
        )
    )
    + f" FROM {SCORES}",
    "v22_stale_listings": f"SELECT f.ListingKey, NeighbourhoodName, LastReviewDate, "
    f"{d('OccupancyRate', 'OccupancyRate')}, {d('RevenueEstimate', 'RevenueEstimate')} "
    f"FROM {PERF} WHERE IsStaleListing = 1",
    "v23_investment_cards": f"SELECT {avg('EstimatedPropertyValue')} AS avg_property_value, "
    f"{avg('EstimatedAnnualROIPct')} AS avg_estimated_roi, {ALL_LISTINGS} FROM {PERF}",
    "v23_value_scatter": f"""SELECT a.NeighbourhoodName, total_property_value, avg_property_value,
      total_revenue
      FROM (SELECT NeighbourhoodName, {d(REV, "total_revenue")} FROM nights GROUP BY 1) a
      LEFT JOIN (SELECT NeighbourhoodName, {avg("EstimatedPropertyValue")} AS avg_property_value,
                   {d("sum(EstimatedPropertyValue)", "total_property_value")}
                 FROM {PERF} GROUP BY 1) b
      ON a.NeighbourhoodName IS NOT DISTINCT FROM b.NeighbourhoodName""",
    "v23_investment_table": library.SQL["q15_investment_ranking"],
    "v24_sliced_cards": cards(f"Date BETWEEN DATE '1996-03-10' AND DATE '1999-10-20' AND {AREAS}", AREAS),
    "v24_sliced_trend": combo(
        "YearMonth", "YearMonth BETWEEN '1997-06' AND '1999-06'", AREAS
    ),
}
