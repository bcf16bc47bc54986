"""Every measure evaluated along a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nightledger.operators import measures as m

MONTH = ["DimDate.YearMonth"]
AREA = ["DimNeighbourhood.NeighbourhoodName"]
ROOM = ["DimListing.RoomType"]


def _evaluate(names: list[str], by: list[str] | None = None, where: dict | None = None):
    return lambda w: m.evaluate(w.star(), names, by, where)


def m09_listing_revenue_rank(w) -> DataFrame:
    return m.listing_revenue_rank(w.star())


def m10_neighbourhood_rank(w) -> DataFrame:
    return m.neighbourhood_revenue_rank(w.star())


def m11_top_ten_listings(w) -> DataFrame:
    return m.top_ten_flag(m.listing_revenue_rank(w.star()))


def m11_top_ten_private_rooms(w) -> DataFrame:
    ranked = m.listing_revenue_rank(w.star(), {"DimListing": "RoomType = 'Private room'"})
    return m.top_ten_flag(ranked)


def m28_metric_selector(w) -> DataFrame:
    return m.all_metrics(w.star(), AREA)


def m29_granularity(w) -> DataFrame:
    w["review_rows"]  # first, as raw listings count them
    return m.evaluate(w.star(), ["total_revenue", "review_count"], [m.granularity("Quarter")])


QUERIES = {
    "m01_total_revenue": _evaluate(["total_revenue"], MONTH + AREA),
    "m02_total_listings": _evaluate(["total_listings"], ROOM),
    "m03_avg_occupancy": _evaluate(["avg_occupancy"], AREA),
    "m04_adr": _evaluate(["adr"], MONTH),
    "m05_revpar": _evaluate(["revpar"], ["DimDate.DayName"]),
    "m06_mom_growth": _evaluate(["revenue_mom_growth"], MONTH),
    "m07_yoy_growth": _evaluate(["revenue_yoy_growth"], MONTH),
    "m08_trailing_average": _evaluate(["revenue_3m_avg"], MONTH + AREA),
    "m09_listing_revenue_rank": m09_listing_revenue_rank,
    "m10_neighbourhood_rank": m10_neighbourhood_rank,
    "m11_top_ten_listings": m11_top_ten_listings,
    "m11_top_ten_private_rooms": m11_top_ten_private_rooms,
    "m12_cumulative_revenue": _evaluate(["cumulative_revenue"], MONTH),
    "m12_cumulative_revenue_since_1996": _evaluate(
        ["cumulative_revenue"], MONTH, {"DimDate": "Year >= 1996"}
    ),
    "m13_pricing_opportunities": _evaluate(["pricing_opportunities"], AREA),
    "m14_superhost_share": _evaluate(["superhost_revenue_share"], AREA),
    "m15_avg_estimated_roi": _evaluate(["avg_estimated_roi"], AREA),
    "m16_overpriced_listings": _evaluate(["overpriced_listings"], AREA),
    "m17_underpriced_listings": _evaluate(["underpriced_listings"], AREA),
    "m18_avg_property_value": _evaluate(["avg_property_value"], ROOM),
    "m19_total_property_value": _evaluate(["total_property_value"], ROOM),
    "m20_stale_listings": _evaluate(["stale_listings"], ["DimListing.PriceCategory"]),
    "m21_review_count": _evaluate(["review_count"], MONTH),
    "m22_avg_rating": _evaluate(["avg_rating"], AREA),
    "m23_avg_cleanliness": _evaluate(["avg_cleanliness"], AREA),
    "m24_avg_checkin": _evaluate(["avg_checkin"], AREA),
    "m25_avg_communication": _evaluate(["avg_communication"], AREA),
    "m26_avg_location": _evaluate(["avg_location"], AREA),
    "m27_avg_value": _evaluate(["avg_value"], AREA),
    "m28_metric_selector": m28_metric_selector,
    "m29_granularity": m29_granularity,
}
