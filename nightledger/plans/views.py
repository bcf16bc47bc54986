"""Report views (V01-V24): each is a measure evaluation or a small plan over the star.

Every view takes the same ``where`` as the measures, so drill-through and the global
date and neighbourhood slicers are arguments rather than separate code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.labels import EXPERIENCE_TIERS, WELL_PRICED, review_score_bucket
from nightledger.functions.numeric import avg_exact, ratio
from nightledger.operators import measures as m
from nightledger.operators.scalars import with_values
from nightledger.plans import library

MONTH = "DimDate.YearMonth"
AREA = "DimNeighbourhood.NeighbourhoodName"
TIER = "DimHost.ExperienceTier"
NIGHTS = m.CALENDAR


def _per_listing(w, where: dict | None = None, by: tuple = ()) -> DataFrame:
    return (
        m.context(w.star(), NIGHTS, list(by), where or {})
        .groupBy("ListingKey", *m._names(list(by)))
        .agg(
            F.sum("BookedRevenue").alias("revenue"),
            F.sum("IsBooked").alias("booked"),
            F.sum("Nights").alias("nights"),
        )
    )


def v01_executive_cards(w, where=None):
    cards = ["total_revenue", "total_listings", "avg_occupancy", "revpar", "pricing_opportunities"]
    return m.evaluate(w.star(), cards, [], where)


def v02_monthly_trend(w, where=None):
    return m.evaluate(w.star(), ["total_revenue", "revenue_3m_avg"], [MONTH], where)


def v03_listing_map(w, where=None):
    revenue = _per_listing(w, where).select("ListingKey", "revenue")
    places = w["master"].select(
        F.col("id").alias("ListingKey"), "latitude", "longitude", "price_category"
    )
    total = F.coalesce("revenue", F.lit(0)).cast("double").alias("total_revenue")
    return places.join(revenue, "ListingKey", "inner" if where else "left").select(
        "ListingKey", "latitude", "longitude", "price_category", total
    )


def v04_top_neighbourhoods(w, where=None, n: int = 5):
    return m.neighbourhood_revenue_rank(w.star(), where).where(F.col("revenue_rank") <= n)


def v05_superhost_split(w, where=None):
    by_status = m.evaluate(w.star(), ["total_revenue"], ["DimHost.IsSuperhost"], where)
    total = by_status.agg(F.sum("total_revenue").alias("all"))
    return with_values(by_status, total).select(
        "IsSuperhost", "total_revenue", ratio(F.col("total_revenue"), F.col("all")).alias("share")
    )


def v06_period_toggle(w, where=None):
    """The last month with nights, and the year up to it."""
    rows = m.context(w.star(), NIGHTS, [MONTH], where or {})
    monthly = rows.groupBy("YearMonth").agg(
        F.sum("BookedRevenue").alias("revenue"),
        F.sum("IsBooked").alias("booked"),
        F.sum("Nights").alias("nights"),
    )
    last = monthly.agg(F.max("YearMonth").alias("last"))
    year = F.substring("YearMonth", 1, 4) == F.substring("last", 1, 4)
    periods = F.array_compact(
        F.array(
            F.when(F.col("YearMonth") == F.col("last"), "This Month"),
            F.when(year, "Year to Date"),
        )
    )
    return (
        with_values(monthly, last)
        .select("revenue", "booked", "nights", F.explode(periods).alias("period"))
        .groupBy("period")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            ratio(F.sum("booked"), F.sum("nights")).alias("avg_occupancy"),
            ratio(F.sum("revenue"), F.sum("nights")).alias("revpar"),
        )
    )


def v07_revenue_combo(w, where=None, granularity="YearMonth"):
    names = ["total_revenue", "revenue_mom_growth", "cumulative_revenue"]
    return m.evaluate(w.star(), names, [m.granularity(granularity)], where)


def v07_revenue_combo_quarter(w):
    return v07_revenue_combo(w, granularity="Quarter")


def v07_revenue_combo_year(w):
    return v07_revenue_combo(w, granularity="Year")


def v08_room_quarter_matrix(w, where=None):
    """Revenue by room type and quarter, with a total column and a total row."""
    rows = m.context(w.star(), NIGHTS, ["DimListing.RoomType", "DimDate.Quarter"], where or {})
    cells = rows.groupBy("RoomType", "Quarter").agg(F.sum("BookedRevenue").alias("revenue"))
    quarters = [
        F.sum(F.when(F.col("Quarter") == q, F.col("revenue"))).alias(f"q{q}") for q in range(1, 5)
    ]
    is_total = F.grouping("RoomType") == 1
    label = F.when(is_total, "Total").otherwise(F.coalesce("RoomType", F.lit("(none)")))
    return (
        cells.rollup("RoomType")
        .agg(label.alias("label"), *quarters, F.sum("revenue").alias("total"))
        .select(F.col("label").alias("room_type"), "q1", "q2", "q3", "q4", "total")
    )


def v09_adr_occupancy_scatter(w, where=None):
    return _per_listing(w, where, ("DimListing.PriceCategory",)).select(
        "ListingKey",
        "PriceCategory",
        ratio(F.col("revenue"), F.col("booked")).alias("adr"),
        ratio(F.col("booked"), F.col("nights")).alias("avg_occupancy"),
        F.col("revenue").alias("total_revenue"),
    )


def v10_occupancy_trends(w, where=None):
    return m.evaluate(w.star(), ["avg_occupancy"], [AREA, MONTH], where)


def v11_neighbourhood_summary(w, where=None):
    star = w.star()
    prices = (
        m.context(star, m.PERFORMANCE, [AREA, "DimListing.BasePrice"], where or {})
        .groupBy("NeighbourhoodName")
        .agg(
            F.count("ListingKey").alias("listing_count"),
            avg_exact(F.col("BasePrice")).alias("avg_price"),
        )
    )
    shown = m.evaluate(star, ["avg_occupancy", "total_revenue", "avg_estimated_roi"], [AREA], where)
    match = shown["NeighbourhoodName"].eqNullSafe(prices["NeighbourhoodName"])
    return shown.join(prices, match, "left").drop(prices["NeighbourhoodName"])


def v12_drill_neighbourhood(w):
    """The monthly trend of the neighbourhood with the highest key, as an example."""
    return v02_monthly_trend(w, {"DimNeighbourhood": "NeighbourhoodName = 'NATION_9'"})


def v12_drill_host(w):
    return v09_adr_occupancy_scatter(w, {"DimHost": "HostKey = 7"})


def v12_drill_listing(w):
    return v02_monthly_trend(w, {"DimListing": "ListingKey = 12"})


def v13_pricing_cards(w, where=None):
    cards = ["pricing_opportunities", "overpriced_listings", "underpriced_listings"]
    return m.evaluate(w.star(), cards, [], where)


def v13_price_scatter(w, signal: str | None = None, where=None):
    """Base price against ADR; ``signal`` keeps one pricing signal, None keeps all."""
    rows = m.context(w.star(), m.PERFORMANCE, ["DimListing.BasePrice"], where or {})
    if signal:
        rows = rows.where(F.col("PricingSignal") == signal)
    return rows.select("ListingKey", "BasePrice", "ADR", "PricingSignal")


def v14_act_first(w, where=None):
    rows = m.context(w.star(), m.PERFORMANCE, [AREA], where or {})
    return (
        rows.where(F.col("PricingSignal") != WELL_PRICED)
        .select("ListingKey", "NeighbourhoodName", "ADR", "PricingGap", "PricingSignal")
        .orderBy(F.abs("PricingGap").desc(), "ListingKey")
    )


def v15_occupancy_by_price(w, where=None):
    return m.evaluate(w.star(), ["avg_occupancy"], ["DimListing.PriceCategory"], where)


def _host_scatter(w, where=None):
    star = w.star()
    scores = (
        m.context(star, m.SCORES, [], where or {})
        .groupBy("HostKey")
        .agg(avg_exact(F.col("CompositeScore")).alias("avg_composite"))
    )
    nights = (
        m.context(star, NIGHTS, [], where or {})
        .where(F.col("HostKey").isNotNull())
        .groupBy("HostKey")
        .agg(
            ratio(F.sum("IsBooked"), F.sum("Nights")).alias("avg_occupancy"),
            F.sum("BookedRevenue").alias("total_revenue"),
        )
    )
    tiers = star["DimHost"].select("HostKey", "ExperienceTier")
    return nights.join(scores, "HostKey", "left").join(tiers, "HostKey")


def v16_host_scatter(w, where=None):
    return _host_scatter(w, where)


def v17_revenue_by_tier(w, where=None):
    return m.evaluate(w.star(), ["total_revenue"], [TIER], where)


def v17_superhost_pair(w, where=None):
    """Occupancy, RevPAR and mean composite score of superhosts and others."""
    star = w.star()
    by = ["DimHost.IsSuperhost"]
    scores = (
        m.context(star, m.SCORES, by, where or {})
        .groupBy("IsSuperhost")
        .agg(avg_exact(F.col("CompositeScore")).alias("avg_composite"))
    )
    shown = m.evaluate(star, ["avg_occupancy", "revpar"], by, where)
    return shown.join(scores, "IsSuperhost")


def v18_new_hosts(w):
    return _host_scatter(w, {"DimHost": f"ExperienceTier = '{EXPERIENCE_TIERS[0]}'"})


def v19_review_volume(w, where=None, granularity="YearMonth"):
    return m.evaluate(w.star(), ["review_count"], [m.granularity(granularity)], where)


def v19_review_volume_year(w):
    return v19_review_volume(w, granularity="Year")


def v20_revenue_by_score(w, where=None):
    scores = w.star()["FactReviewScores"].where(F.col("CompositeScore").isNotNull())
    bucket = review_score_bucket(F.col("CompositeScore")).alias("review_score_bucket")
    return (
        _per_listing(w, where)
        .join(scores.select("ListingKey", bucket), "ListingKey")
        .groupBy("review_score_bucket")
        .agg(F.sum("revenue").alias("total_revenue"))
    )


def v21_sub_scores(w, where=None):
    names = ["avg_cleanliness", "avg_checkin", "avg_communication", "avg_location", "avg_value"]
    return m.evaluate(w.star(), names, [], where)


def v22_stale_listings(w, where=None):
    rows = m.context(
        w.star(), m.PERFORMANCE, [AREA, "DimListing.IsStaleListing", "DimListing.LastReviewDate"],
        where or {},
    )
    return rows.where(F.col("IsStaleListing") == 1).select(
        "ListingKey", "NeighbourhoodName", "LastReviewDate", "OccupancyRate", "RevenueEstimate"
    )


def v23_investment_cards(w, where=None):
    names = ["avg_property_value", "avg_estimated_roi", "total_listings"]
    return m.evaluate(w.star(), names, [], where)


def v23_value_scatter(w, where=None):
    """Property value against revenue per neighbourhood."""
    names = ["total_property_value", "avg_property_value", "total_revenue"]
    return m.evaluate(w.star(), names, [AREA], where)


def v23_investment_table(w):
    return library.q15_investment_ranking(w)


def v24_sliced_cards(w):
    """The card strip under a date range and a neighbourhood choice."""
    return v01_executive_cards(
        w,
        {
            "DimDate": "Date BETWEEN DATE'1996-03-10' AND DATE'1999-10-20'",
            "DimNeighbourhood": "NeighbourhoodName IN ('NATION_1', 'NATION_2', 'NATION_9')",
        },
    )


def v24_sliced_trend(w):
    """The growth trend under a month range and a neighbourhood choice."""
    return v07_revenue_combo(
        w,
        {
            "DimDate": "YearMonth BETWEEN '1997-06' AND '1999-06'",
            "DimNeighbourhood": "NeighbourhoodName IN ('NATION_1', 'NATION_2', 'NATION_9')",
        },
    )


QUERIES = {
    name: f for name, f in list(globals().items()) if name[0] == "v" and name[1:3].isdigit()
}
