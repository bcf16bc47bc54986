"""The question library (Q01-Q21).

``w`` is a warehouse. Listing-grain questions read ``listing_facts`` and calendar
questions read ``fact_calendar_monthly``, so neither repeats a large join. Groups are
summed on their surrogate key before the dimension's names are attached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.functions.labels import (
    PRICE_CATEGORIES,
    RISK_LEVELS,
    WELL_PRICED,
    amenity_tier,
    performance_tier,
    review_score_bucket,
    risk_level,
    sort_position,
)
from nightledger.functions.numeric import avg_exact, half_away, ratio
from nightledger.operators.ranking import global_row_numbers, ntile_of, top_per_group
from nightledger.operators.scalars import with_values


def pct1(c: Column) -> Column:
    return half_away(c * 100, 1)


def performing(w) -> DataFrame:
    """Listings that have calendar rows."""
    return w["listing_facts"].where("has_performance")


def _sums(**columns: str) -> list[Column]:
    """Sum and count of each column, so that averages can be combined later."""
    out = []
    for name, column in columns.items():
        out += [F.sum(column).alias(f"{name}_sum"), F.count(column).alias(f"{name}_n")]
    return out


def _combined(name: str) -> Column:
    """Average over groups that were summed by ``_sums``."""
    return ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))


def q01_top_neighbourhoods(w, n: int = 15) -> DataFrame:
    # a listing has one row, so counting rows counts distinct listings
    per_key = performing(w).groupBy("neighbourhood_id").agg(
        F.count("listing_id").alias("listings"),
        F.sum("revenue_estimate").alias("revenue"),
        *_sums(revpar="revpar", occ="occupancy_rate"),
    )
    return (
        per_key.join(w["neighbourhoods"], "neighbourhood_id")
        .groupBy("neighbourhood_name")
        .agg(
            F.sum("listings").alias("listing_count"),
            F.sum("revenue").alias("total_revenue"),
            half_away(_combined("revpar")).alias("avg_revpar"),
            pct1(_combined("occ")).alias("avg_occupancy_pct"),
        )
        .orderBy(F.desc("total_revenue"), "neighbourhood_name")
        .limit(n)
    )


def q02_top_hosts(w, n: int = 10) -> DataFrame:
    per_host = performing(w).groupBy("host_id").agg(
        F.count("listing_id").alias("num_listings"),
        F.sum("revenue_estimate").alias("total_revenue"),
    )
    order = [F.desc("total_revenue"), F.asc("host_id")]
    top = per_host.join(w["hosts"].select("host_id", "experience_tier"), "host_id")
    # n rows are left, so numbering them in one task is fine
    return (
        top.orderBy(*order)
        .limit(n)
        .select(
            "host_id",
            "experience_tier",
            "num_listings",
            "total_revenue",
            F.row_number().over(Window.orderBy(*order)).alias("revenue_rank"),
        )
        .orderBy("revenue_rank")
    )


def _per_host(w) -> DataFrame:
    return performing(w).groupBy("host_id").agg(
        *_sums(
            occ="occupancy_rate",
            score="composite_score",
            revpar="revpar",
            revenue="revenue_estimate",
        )
    )


def q03_host_tiers(w) -> DataFrame:
    occ, score = ratio(F.col("occ_sum"), F.col("occ_n")), ratio(F.col("score_sum"), F.col("score_n"))
    return (
        _per_host(w)
        .join(w["hosts"].select("host_id"), "host_id")
        .select(
            "host_id",
            pct1(occ).alias("avg_occupancy_pct"),
            half_away(score).alias("avg_review_score"),
            performance_tier(occ, score).alias("performance_tier"),
        )
        .orderBy(F.desc("avg_occupancy_pct"), "host_id")
    )


def monthly_revenue(w) -> DataFrame:
    return (
        w["fact_calendar_monthly"]
        .groupBy(F.col("YearMonth").alias("yr_month"))
        .agg(F.sum("BookedRevenue").alias("total_revenue"))
    )


def _growth(now: Column, before: Column) -> Column:
    return half_away(F.try_divide((now - before).cast("double") * 100, before.cast("double")))


def q04_month_over_month(w) -> DataFrame:
    by_month = Window.orderBy("yr_month")  # one row per month
    return (
        monthly_revenue(w)
        .withColumn("prior_month_revenue", F.lag("total_revenue").over(by_month))
        .withColumn("mom_growth_pct", _growth(F.col("total_revenue"), F.col("prior_month_revenue")))
        .orderBy("yr_month")
    )


def q05_declining_occupancy(w) -> DataFrame:
    months = Window.partitionBy("listing_id").orderBy("yr_month")
    occ = (
        w["fact_calendar_monthly"]
        .select(
            F.col("ListingKey").alias("listing_id"),
            F.col("YearMonth").alias("yr_month"),
            ratio(F.col("IsBooked"), F.col("Nights")).alias("occupancy_rate"),
        )
        .withColumn("occ_prev1", F.lag("occupancy_rate", 1).over(months))
        .withColumn("occ_prev2", F.lag("occupancy_rate", 2).over(months))
    )
    falling = (F.col("occupancy_rate") < F.col("occ_prev1")) & (
        F.col("occ_prev1") < F.col("occ_prev2")
    )
    return occ.where(falling).orderBy("listing_id", "yr_month")


def q06_pricing_urgency(w, n: int = 5) -> DataFrame:
    flagged = performing(w).where(F.col("pricing_signal") != WELL_PRICED)
    ranked = top_per_group(
        flagged.select(
            "neighbourhood_id", "listing_id", "base_price", "adr", "pricing_gap", "pricing_signal"
        ),
        ["neighbourhood_id"],
        [F.abs("pricing_gap").desc()],
        n,
        "rank",
        "pricing_urgency_rank",
    )
    return (
        ranked.join(
            w["neighbourhoods"].select("neighbourhood_id", "neighbourhood_name"), "neighbourhood_id"
        )
        .select(
            "neighbourhood_name",
            "listing_id",
            "base_price",
            "adr",
            "pricing_gap",
            "pricing_signal",
            "pricing_urgency_rank",
        )
        .orderBy("neighbourhood_name", "pricing_urgency_rank", "listing_id")
    )


def q07_revpar_quartile(w) -> DataFrame:
    rows = performing(w).select("listing_id", "revpar")
    placed = global_row_numbers(rows, "revpar", "listing_id")
    return placed.select(
        "listing_id",
        "revpar",
        ntile_of(F.col("row_number"), F.col("row_total"), 4).alias("revpar_quartile"),
    ).orderBy("revpar", "listing_id")


def q08_superhost_comparison(w) -> DataFrame:
    return (
        _per_host(w)
        .join(w["hosts"].select("host_id", "is_superhost"), "host_id")
        .groupBy("is_superhost")
        .agg(
            F.count(F.lit(1)).alias("num_hosts"),
            pct1(_combined("occ")).alias("avg_occupancy_pct"),
            half_away(_combined("revpar")).alias("avg_revpar"),
            half_away(_combined("score")).alias("avg_review_score"),
        )
    )


def q09_running_revenue(w) -> DataFrame:
    per_key = (
        w["fact_calendar_monthly"]
        .where(F.col("NeighbourhoodKey").isNotNull())
        .groupBy(
            F.col("NeighbourhoodKey").alias("neighbourhood_id"),
            F.col("YearMonth").alias("yr_month"),
        )
        .agg(F.sum("BookedRevenue").alias("month_revenue"))
    )
    running = (
        Window.partitionBy("neighbourhood_name")
        .orderBy("yr_month")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        per_key.join(w["neighbourhoods"], "neighbourhood_id")
        .select("neighbourhood_name", "yr_month", "month_revenue")
        .withColumn("cumulative_revenue", F.sum("month_revenue").over(running))
        .orderBy("neighbourhood_name", "yr_month")
    )


def q10_best_listings(w, n: int = 3) -> DataFrame:
    ranked = top_per_group(
        performing(w).select("neighbourhood_id", "listing_id", "revpar"),
        ["neighbourhood_id"],
        [F.col("revpar").desc(), F.col("listing_id").asc()],
        n,
        "row_number",
        "rn",
    )
    return (
        ranked.join(w["neighbourhoods"], "neighbourhood_id")
        .orderBy("neighbourhood_name", "rn")
        .select("neighbourhood_name", "listing_id", "revpar")
    )


def q11_experience_tiers(w) -> DataFrame:
    return (
        _per_host(w)
        .join(w["hosts"].select("host_id", "experience_tier"), "host_id")
        .groupBy("experience_tier")
        .agg(
            F.count(F.lit(1)).alias("num_hosts"),
            pct1(_combined("occ")).alias("avg_occupancy_pct"),
            half_away(_combined("score")).alias("avg_review_score"),
            half_away(_combined("revenue")).alias("avg_revenue_per_listing"),
        )
        .orderBy(F.desc("avg_revenue_per_listing"), "experience_tier")
    )


def month_start(year_month: Column) -> Column:
    return F.concat(year_month, F.lit("-01")).cast("date")


def q12_seasonality(w) -> DataFrame:
    month = month_start(F.col("YearMonth"))
    pooled = (
        w["fact_calendar_monthly"]
        .groupBy("YearMonth")
        .agg(F.sum("IsBooked").alias("booked"), F.sum("Nights").alias("nights"))
        .groupBy(
            F.date_format(month, "MMMM").alias("month_name"), F.month(month).alias("month_num")
        )
        .agg(ratio(F.sum("booked"), F.sum("nights")).alias("occ"))
    )
    # twelve rows at most
    return (
        pooled.withColumn("demand_rank", F.rank().over(Window.orderBy(F.desc("occ"))))
        .orderBy("month_num")
        .select("month_name", pct1(F.col("occ")).alias("avg_occupancy_pct"), "demand_rank")
    )


def q13_score_buckets(w) -> DataFrame:
    return (
        performing(w)
        .where(F.col("composite_score").isNotNull())
        .groupBy(review_score_bucket(F.col("composite_score")).alias("review_score_bucket"))
        .agg(
            F.count(F.lit(1)).alias("num_listings"),
            half_away(avg_exact(F.col("revenue_estimate"))).alias("avg_revenue"),
            pct1(avg_exact(F.col("occupancy_rate"))).alias("avg_occupancy_pct"),
        )
        .orderBy(F.desc("avg_revenue"), "review_score_bucket")
    )


def q14_risk_levels(w) -> DataFrame:
    level = risk_level(F.col("is_stale_listing"), F.col("occupancy_rate"))
    return (
        performing(w)
        .groupBy(level.alias("risk_level"))
        .agg(F.count(F.lit(1)).alias("num_listings"))
        .orderBy(sort_position(F.col("risk_level"), RISK_LEVELS))
    )


def q15_investment_ranking(w) -> DataFrame:
    per_key = (
        performing(w)
        .where("has_valuation")
        .groupBy("neighbourhood_id")
        .agg(
            F.count("listing_id").alias("listings"),
            *_sums(
                value="estimated_property_value",
                revenue="revenue_estimate",
                roi="estimated_annual_roi_pct",
            ),
        )
    )
    return (
        per_key.join(w["neighbourhoods"], "neighbourhood_id")
        .groupBy("neighbourhood_name")
        .agg(
            F.sum("listings").alias("listing_count"),
            half_away(_combined("value"), 0).alias("avg_estimated_property_value"),
            half_away(_combined("revenue")).alias("avg_annual_revenue"),
            half_away(_combined("roi")).alias("avg_estimated_roi_pct"),
        )
        .orderBy(F.desc("avg_estimated_roi_pct"), "neighbourhood_name")
    )


def q16_month_coverage(w) -> DataFrame:
    present = (
        w["fact_calendar_monthly"].select(month_start(F.col("YearMonth")).alias("m")).distinct()
    )
    month = F.expr("INTERVAL 1 MONTH")
    spine = (
        present.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
        .where(F.col("lo").isNotNull())
        .select(F.explode(F.sequence("lo", "hi", month)).alias("expected"))
    )
    status = F.when(F.col("m").isNull(), "MISSING").otherwise("Present")
    return (
        spine.join(present, F.col("expected") == F.col("m"), "left")
        .orderBy("expected")
        .select(
            F.date_format("expected", "yyyy-MM").alias("expected_month"),
            status.alias("coverage_status"),
        )
    )


def q17_price_categories(w) -> DataFrame:
    return (
        performing(w)
        .groupBy("price_category")
        .agg(
            F.count(F.lit(1)).alias("num_listings"),
            half_away(avg_exact(F.col("base_price"))).alias("avg_price"),
            pct1(avg_exact(F.col("occupancy_rate"))).alias("avg_occupancy_pct"),
            half_away(avg_exact(F.col("revpar"))).alias("avg_revpar"),
        )
        .orderBy(sort_position(F.col("price_category"), PRICE_CATEGORIES))
    )


def q18_amenity_tiers(w) -> DataFrame:
    return (
        performing(w)
        .groupBy(amenity_tier(F.col("amenity_count")).alias("amenity_tier"))
        .agg(
            F.count(F.lit(1)).alias("num_listings"),
            half_away(avg_exact(F.col("base_price"))).alias("avg_price"),
            half_away(avg_exact(F.col("revenue_estimate"))).alias("avg_revenue"),
        )
        .orderBy(F.desc("avg_price"), "amenity_tier")
    )


def q19_tier_benchmark(w) -> DataFrame:
    tiers = (
        _per_host(w)
        .join(w["hosts"].select("host_id", "experience_tier"), "host_id")
        .groupBy("experience_tier")
        .agg(F.sum("revpar_sum").alias("revpar_sum"), F.sum("revpar_n").alias("revpar_n"))
    )
    # one row per tier, so the market total over them is a small window
    market = Window.partitionBy()
    tier_avg = ratio(F.col("revpar_sum"), F.col("revpar_n"))
    market_avg = ratio(F.sum("revpar_sum").over(market), F.sum("revpar_n").over(market))
    return (
        tiers.withColumn("tier", tier_avg)
        .withColumn("market", market_avg)
        .select(
            "experience_tier",
            half_away(F.col("tier")).alias("tier_avg_revpar"),
            half_away(F.col("market")).alias("market_avg_revpar"),
            half_away(F.col("tier") - F.col("market")).alias("gap_vs_market"),
        )
        .orderBy(F.desc("tier_avg_revpar"), "experience_tier")
    )


def q20_executive_summary(w) -> DataFrame:
    perf = w["listing_performance"].agg(
        half_away(F.sum("revenue_estimate"), 0).alias("total_estimated_revenue"),
        pct1(avg_exact(F.col("occupancy_rate"))).alias("avg_occupancy_pct"),
        half_away(avg_exact(F.col("revpar"))).alias("avg_revpar"),
    )
    best = (
        performing(w)
        .groupBy("neighbourhood_id")
        .agg(F.sum("revenue_estimate").alias("revenue"))
        .join(w["neighbourhoods"], "neighbourhood_id")
        .orderBy(F.desc("revenue"), "neighbourhood_name")
        .limit(1)
        .agg(F.max("neighbourhood_name").alias("top_neighbourhood_by_revenue"))
    )
    listings = w["listings"].agg(F.count(F.lit(1)).alias("total_listings"))
    hosts = w["hosts"].agg(F.count("host_id").alias("total_hosts"))  # one row per host
    return with_values(with_values(with_values(listings, hosts), perf), best)


def q21_month_over_month_join(w) -> DataFrame:
    now = monthly_revenue(w)
    before = now.select(
        F.date_format(F.add_months(month_start(F.col("yr_month")), 1), "yyyy-MM").alias("next"),
        F.col("total_revenue").alias("prior_month_revenue"),
    )
    return (
        now.join(before, F.col("yr_month") == F.col("next"), "left")
        .select(
            "yr_month",
            "total_revenue",
            "prior_month_revenue",
            _growth(F.col("total_revenue"), F.col("prior_month_revenue")).alias("mom_growth_pct"),
        )
        .orderBy("yr_month")
    )


QUERIES = {
    name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()
}
