"""The insight pack over the master and monthly tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.functions.labels import UNDERPRICED, WELL_PRICED
from nightledger.functions.numeric import avg_exact, ratio
from nightledger.operators.ranking import percent_rank_of
from nightledger.operators.scalars import with_values
from nightledger.plans import library

AREA = "neighbourhood_cleansed"


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def pct_text(c: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", c * 100), F.lit("nan%"))


def market_totals(master: DataFrame) -> DataFrame:
    """One row: listings, revenue, nights-weighted occupancy, RevPAR."""
    return master.agg(
        F.count(F.lit(1)).alias("listings"),
        F.sum("revenue_estimate").alias("revenue"),
        F.sum("booked_nights").alias("booked"),
        F.sum("total_nights_tracked").alias("tracked"),
    ).select(
        "listings",
        "revenue",
        "booked",
        "tracked",
        ratio(F.col("booked"), F.col("tracked")).alias("occupancy"),
        ratio(F.col("revenue"), F.col("tracked")).alias("revpar"),
    )


def neighbourhood_rollup(master: DataFrame) -> DataFrame:
    """Per neighbourhood, including the one without a name."""
    sums = master.groupBy(AREA).agg(
        F.count("id").alias("listings"),
        F.coalesce(F.sum("revenue_estimate"), F.lit(0)).alias("revenue"),
        F.sum("booked_nights").alias("booked"),
        F.sum("total_nights_tracked").alias("tracked"),
        avg_exact(F.col("estimated_annual_roi_pct")).alias("avg_roi"),
        avg_exact(F.col("review_score_composite")).alias("avg_review"),
    )
    total = sums.agg(F.sum("revenue").alias("all_revenue"))
    return with_values(sums, total).select(
        AREA,
        "listings",
        "revenue",
        "booked",
        "tracked",
        "avg_roi",
        "avg_review",
        ratio(F.col("booked"), F.col("tracked")).alias("occupancy"),
        ratio(F.col("revenue"), F.col("all_revenue")).alias("revenue_share"),
    )


def largest_areas(master: DataFrame, n: int) -> DataFrame:
    return neighbourhood_rollup(master).orderBy(F.desc("revenue"), F.asc_nulls_last(AREA)).limit(n)


def revenue_concentration(master: DataFrame, n: int = 3) -> DataFrame:
    """One row: share of the top ``n`` and the leader."""
    top = largest_areas(master, n)
    place = F.struct((-F.col("revenue")).alias("r"), F.col(AREA).isNull(), F.col(AREA).alias("name"))
    sums = top.agg(F.sum("revenue").alias("top_revenue"), F.min(place).alias("first"))
    total = market_totals(master).select(F.col("revenue").alias("all_revenue"))
    return with_values(sums, total).select(
        ratio(F.col("top_revenue"), F.col("all_revenue")).alias("top_share"),
        F.col("first.name").alias("leader"),
    )


def peak_and_low_month(monthly: DataFrame) -> DataFrame:
    """One row; the earliest month wins a tie."""
    by_month = monthly.groupBy("year_month").agg(F.sum("revenue").alias("r"))
    month = F.col("year_month").alias("m")
    return by_month.agg(
        F.min(F.struct((-F.col("r")).alias("r"), month))["m"].alias("peak_month"),
        F.min(F.struct(F.col("r"), month))["m"].alias("low_month"),
    )


def superhost_gaps(master: DataFrame) -> DataFrame:
    """One row: superhosts against others in occupancy, RevPAR and score."""
    is_super = F.col("host_is_superhost")

    def group(prefix: str, test: Column) -> list[Column]:
        def pick(c):
            return F.when(test, F.col(c))

        return [
            F.sum(pick("revenue_estimate")).alias(f"{prefix}_rev"),
            F.sum(pick("booked_nights")).alias(f"{prefix}_booked"),
            F.sum(pick("total_nights_tracked")).alias(f"{prefix}_tracked"),
            avg_exact(pick("review_score_composite")).alias(f"{prefix}_score"),
        ]

    sums = master.agg(*group("s", is_super), *group("n", ~is_super))
    occ = {p: ratio(F.col(f"{p}_booked"), F.col(f"{p}_tracked")) for p in "sn"}
    revpar = {p: ratio(F.col(f"{p}_rev"), F.col(f"{p}_tracked")) for p in "sn"}
    return sums.select(
        (ratio(occ["s"], occ["n"]) - 1).alias("occupancy_gap"),
        (ratio(revpar["s"], revpar["n"]) - 1).alias("revpar_gap"),
        (F.col("s_score") - F.col("n_score")).alias("score_gap"),
    )


def stale_count(master: DataFrame) -> DataFrame:
    """Here a missing flag counts as stale."""
    return master.agg(
        F.count_if(F.coalesce("is_stale_listing", F.lit(True))).alias("stale_listings")
    )


def pricing_flags(master: DataFrame) -> DataFrame:
    """I07."""
    return master.agg(F.count_if(F.col("pricing_signal") != WELL_PRICED).alias("pricing_flags"))


def best_roi_area(master: DataFrame) -> DataFrame:
    """One row: the neighbourhood with the highest mean ROI, first name on ties."""
    areas = neighbourhood_rollup(master).where(F.col("avg_roi").isNotNull())
    place = F.struct((-F.col("avg_roi")).alias("r"), F.col(AREA).isNull(), F.col(AREA).alias("name"))
    best = areas.agg(F.min(place).alias("best"))
    return best.select(
        F.col("best.name").alias("best_roi_area"), (-F.col("best.r")).alias("avg_roi")
    )


# Insight ids and themes.
THEMES = {
    "EXEC-01": "Executive",
    "EXEC-02": "Revenue concentration",
    "SEAS-01": "Seasonality",
    "HOST-01": "Host performance",
    "QUALITY-01": "Guest experience",
    "PRICING-01": "Pricing",
    "INVEST-01": "Investment",
}

ADVICE = {
    "EXEC-01": (
        "Take the areas that earn most as the yardstick, and weigh RevPAR and the depth of "
        "supply before adding listings.",
        "Revenue and occupancy come from availability flags, not from confirmed bookings.",
    ),
    "EXEC-02": (
        "Defend the core areas and try growth in smaller ones with good RevPAR and occupancy.",
        "The ranking of areas depends on which listings happen to be present.",
    ),
    "SEAS-01": (
        "Keep a seasonal price calendar and check it each month against occupancy and RevPAR.",
        "One window of nights is not a trend over several years.",
    ),
    "HOST-01": (
        "Coach the hosts who are close to the superhost threshold.",
        "The comparison is observational; the status need not be the cause.",
    ),
    "QUALITY-01": (
        "Invite these hosts back with a refresh prompt and a short booking incentive.",
        "A missing recent review may mean inactivity rather than poor quality.",
    ),
    "PRICING-01": (
        "Use the signals as provisional until nightly prices are known for every listing.",
        "Where the calendar holds no price, the base price stands in for it.",
    ),
    "INVEST-01": (
        "Use the ranking to order further checks, not as investment advice.",
        "Property values and ROI are synthetic estimates made from nightly prices.",
    ),
}


def market_facts(master: DataFrame, top: int = 3) -> DataFrame:
    """One row with what I01, I03 and I05-I08 find, from one pass over the listings.

    Listings are summed by neighbourhood; all else is taken from that small frame.
    """
    is_super, revenue = F.col("host_is_superhost"), F.coalesce("revenue", F.lit(0))
    areas = master.groupBy(AREA).agg(
        F.count(F.lit(1)).alias("listings"),
        F.sum("revenue_estimate").alias("revenue"),
        F.sum("booked_nights").alias("booked"),
        F.sum("total_nights_tracked").alias("tracked"),
        avg_exact(F.col("estimated_annual_roi_pct")).alias("avg_roi"),
        *[
            F.sum(F.when(test, F.col(c))).alias(f"{prefix}_{name}")
            for prefix, test in (("s", is_super), ("n", ~is_super))
            for c, name in (("revenue_estimate", "rev"), ("total_nights_tracked", "tracked"))
        ],
        F.count_if(F.coalesce("is_stale_listing", F.lit(True))).alias("stale_listings"),
        F.count_if(F.col("pricing_signal") != WELL_PRICED).alias("pricing_flags"),
    )
    by_revenue = Window.orderBy(F.desc(revenue), F.asc_nulls_last(AREA))  # one row per area
    named = F.struct((-F.col("avg_roi")).alias("r"), F.col(AREA).isNull(), F.col(AREA).alias("name"))
    added = ["listings", "revenue", "booked", "tracked", "s_rev", "s_tracked", "n_rev", "n_tracked"]
    sums = areas.withColumn("place", F.row_number().over(by_revenue)).agg(
        *[F.sum(c).alias(c) for c in added],
        F.sum(F.when(F.col("place") <= top, revenue)).alias("top_revenue"),
        F.max(F.when(F.col("place") == 1, F.col(AREA))).alias("leader"),
        F.min(F.when(F.col("avg_roi").isNotNull(), named)).alias("best"),
        F.coalesce(F.sum("stale_listings"), F.lit(0)).alias("stale_listings"),
        F.coalesce(F.sum("pricing_flags"), F.lit(0)).alias("pricing_flags"),
    )
    revpar = {p: ratio(F.col(f"{p}_rev"), F.col(f"{p}_tracked")) for p in "sn"}
    return sums.select(
        F.coalesce("listings", F.lit(0)).alias("listings"),
        "revenue",
        ratio(F.col("booked"), F.col("tracked")).alias("occupancy"),
        ratio(F.col("top_revenue"), F.col("revenue")).alias("top_share"),
        "leader",
        (ratio(revpar["s"], revpar["n"]) - 1).alias("revpar_gap"),
        "stale_listings",
        "pricing_flags",
        F.col("best.name").alias("best_roi_area"),
    )


def build(master: DataFrame, monthly: DataFrame) -> DataFrame:
    """The seven insights with their texts, in order of ``position``."""
    facts = with_values(market_facts(master), peak_and_low_month(monthly))

    def number(c: str) -> Column:
        return F.format_number(F.col(c), 0)

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    findings = {
        "EXEC-01": text(
            "The market has ", number("listings"), " priced listings earning an estimated ",
            money_text(F.col("revenue")), " at ", pct_text(F.col("occupancy")),
            " weighted occupancy.",
        ),
        "EXEC-02": text(
            "Three neighbourhoods earn ", pct_text(F.col("top_share")),
            " of estimated revenue; the largest is ", F.coalesce("leader", F.lit("nan")), ".",
        ),
        "SEAS-01": text(
            "Estimated revenue is highest in ", F.col("peak_month"), " and lowest in ",
            F.col("low_month"), ".",
        ),
        "HOST-01": text(
            "RevPAR of superhosts is ", pct_text(F.col("revpar_gap")), " above that of other hosts."
        ),
        "QUALITY-01": text(
            number("stale_listings"), " listings are stale under the 365-day review rule."
        ),
        "PRICING-01": text(
            number("pricing_flags"), " listings are flagged by the pricing-gap rule."
        ),
        "INVEST-01": text(
            F.coalesce("best_roi_area", F.lit("nan")), " ranks highest on estimated ROI."
        ),
    }
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(key).alias("InsightID"),
            F.lit(THEMES[key]).alias("Theme"),
            finding.alias("Finding"),
            F.lit(ADVICE[key][0]).alias("Recommendation"),
            F.lit(ADVICE[key][1]).alias("Caveat"),
        )
        for i, (key, finding) in enumerate(findings.items())
    ]
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def share_of_top(master: DataFrame, n: int = 3) -> DataFrame:
    """Running revenue and listing share of the ``n`` largest neighbourhoods."""
    total = market_totals(master).select(
        F.col("revenue").alias("all_revenue"), F.col("listings").alias("all_listings")
    )
    # n rows are left, so numbering them in one task is fine
    order = Window.orderBy(F.desc("revenue"), F.asc_nulls_last(AREA))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        with_values(largest_areas(master, n), total)
        .select(
            AREA,
            F.row_number().over(order).alias("revenue_rank"),
            ratio(F.sum("revenue").over(running), F.col("all_revenue")).alias("revenue_share"),
            ratio(F.sum("listings").over(running), F.col("all_listings")).alias("listing_share"),
        )
    )


def under_supplied(master: DataFrame, revpar_from: float = 0.75, supply_to: float = 0.5):
    """High RevPAR with few listings, by rank among the neighbourhoods."""
    areas = (
        neighbourhood_rollup(master)
        .where(F.col(AREA).isNotNull())
        .select(AREA, "listings", ratio(F.col("revenue"), F.col("tracked")).alias("revpar"))
    )
    ranked = percent_rank_of(areas, "revpar", AREA, "revpar_rank")
    ranked = percent_rank_of(ranked, "listings", AREA, "supply_rank")
    return ranked.where(
        (F.col("revpar_rank") >= revpar_from) & (F.col("supply_rank") <= supply_to)
    )


def growth_before_dip(monthly_revenue: DataFrame) -> DataFrame:
    """Months in which revenue fell, with the number of rising months just before."""
    by_month = Window.orderBy("yr_month")  # one row per month
    rev, prior = F.col("total_revenue"), F.col("prior")
    steps = (
        monthly_revenue.withColumn("prior", F.lag("total_revenue").over(by_month))
        .withColumn("rising", F.coalesce(rev > prior, F.lit(False)))
        .withColumn(
            "run",
            F.sum((~F.col("rising")).cast("int")).over(
                by_month.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
    )
    runs = steps.groupBy((F.col("run") + 1).alias("run")).agg(
        F.count_if("rising").alias("months_of_growth")
    )
    dips = steps.where((rev < prior)).join(runs, "run")
    return dips.where(F.col("months_of_growth") > 0).select(
        "yr_month", "months_of_growth", ratio(rev - prior, prior).alias("change")
    )


def fragile_leaders(master: DataFrame, n: int = 10) -> DataFrame:
    """RevPAR and score ranks among the ``n`` largest neighbourhoods by revenue."""
    top = largest_areas(master, n).select(
        AREA, ratio(F.col("revenue"), F.col("tracked")).alias("revpar"), "avg_review"
    )
    # n rows are left
    return top.select(
        AREA,
        "revpar",
        "avg_review",
        F.rank().over(Window.orderBy(F.desc("revpar"))).alias("revpar_rank"),
        F.rank().over(Window.orderBy(F.asc_nulls_last("avg_review"))).alias("lowest_score_rank"),
    )


def underpriced_share(master: DataFrame) -> DataFrame:
    """Underpriced among flagged listings, per experience tier and overall."""
    flagged = master.where(F.col("pricing_signal") != WELL_PRICED)
    tier = F.coalesce("host_experience_tier", F.lit("(none)"))
    counts = (
        flagged.withColumn("tier", tier)
        .rollup("tier")
        .agg(
            F.count(F.lit(1)).alias("flagged"),
            F.count_if(F.col("pricing_signal") == UNDERPRICED).alias("underpriced"),
        )
    )
    return counts.select(
        F.coalesce("tier", F.lit("All")).alias("experience_tier"),
        "flagged",
        "underpriced",
        ratio(F.col("underpriced"), F.col("flagged")).alias("underpriced_share"),
    )


def stale_share(master: DataFrame) -> DataFrame:
    """Stale share of the inventory, per experience tier and overall (I16)."""
    tier = F.coalesce("host_experience_tier", F.lit("(none)"))
    counts = (
        master.withColumn("tier", tier)
        .rollup("tier")
        .agg(F.count(F.lit(1)).alias("listings"), F.count_if("is_stale_listing").alias("stale"))
    )
    return counts.select(
        F.coalesce("tier", F.lit("All")).alias("experience_tier"),
        "listings",
        "stale",
        ratio(F.col("stale"), F.col("listings")).alias("stale_share"),
    )


def win_back_list(master: DataFrame, max_age_days: int = 730) -> DataFrame:
    """Stale listings younger than two years (I16)."""
    young = F.col("is_stale_listing") & (F.col("listing_age_days") < max_age_days)
    return master.where(young).select(
        "id", "host_id", "host_experience_tier", "listing_age_days", "days_since_last_review"
    )


def price_lag_months(monthly: DataFrame) -> DataFrame:
    """Months in which occupancy fell faster than ADR."""
    by_month = Window.orderBy("year_month")  # one row per month
    sums = monthly.groupBy("year_month").agg(
        F.sum("nights_booked").alias("booked"),
        F.sum("nights_tracked").alias("tracked"),
        F.sum("revenue").alias("revenue"),
    )
    rates = sums.select(
        "year_month",
        ratio(F.col("booked"), F.col("tracked")).alias("occupancy"),
        ratio(F.col("revenue"), F.col("booked")).alias("adr"),
    )

    def change(c: str) -> Column:
        before = F.lag(c).over(by_month)
        return ratio(F.col(c) - before, before)

    moved = rates.withColumn("occupancy_change", change("occupancy")).withColumn(
        "adr_change", change("adr")
    )
    fell = (F.col("occupancy_change") < 0) & (F.col("occupancy_change") < F.col("adr_change"))
    return moved.where(fell).select("year_month", "occupancy_change", "adr_change")


def room_mix_revpar(master: DataFrame) -> DataFrame:
    """RevPAR per room type within each neighbourhood."""
    return master.groupBy(AREA, "room_type").agg(
        F.count(F.lit(1)).alias("listings"),
        ratio(F.sum("revenue_estimate"), F.sum("total_nights_tracked")).alias("revpar"),
    )


def report_lines(pack: DataFrame, totals: DataFrame) -> DataFrame:
    """The report as ordered markdown lines: the insights, then a KPI snapshot."""

    def lines(*cells: Column) -> Column:
        return F.posexplode(F.array(*cells)).alias("line", "value")

    def labelled(label: str, c: str) -> Column:
        return F.concat(F.lit(f"**{label}:** "), F.col(c))

    title = F.concat(F.lit("## "), F.col("InsightID"), F.lit(" - "), F.col("Theme"))
    blank = F.lit("")
    sections = pack.select(
        (F.col("position") + 1).alias("section"),
        lines(
            title,
            labelled("Finding", "Finding"),
            blank,
            labelled("Recommendation", "Recommendation"),
            blank,
            labelled("Caveat", "Caveat"),
            blank,
        ),
    )
    snapshot = totals.select(
        F.lit(len(THEMES) + 1).alias("section"),
        lines(
            F.lit("## Dashboard KPI snapshot"),
            blank,
            F.concat(F.lit("- Listings analyzed: "), F.format_number("listings", 0)),
            F.concat(F.lit("- Estimated revenue: "), money_text(F.col("revenue"))),
            F.concat(F.lit("- Weighted occupancy: "), pct_text(F.col("occupancy"))),
            F.concat(F.lit("- RevPAR: "), money_text(F.col("revpar"))),
            blank,
        ),
    )
    head = totals.select(
        F.lit(0).alias("section"), lines(F.lit("# Business Insights from Current Data"), blank)
    )
    return head.unionByName(sections).unionByName(snapshot).orderBy("section", "line")


def write_report(lines: DataFrame, path: str) -> None:
    """One text file; the report has a fixed number of lines."""
    lines.orderBy("section", "line").select("value").coalesce(1).write.mode("overwrite").text(path)


def i01_market_totals(w):
    return market_totals(w["master"])


def i02_neighbourhood_rollup(w):
    return neighbourhood_rollup(w["master"])


def i03_concentration(w):
    return revenue_concentration(w["master"])


def i04_peak_month(w):
    return peak_and_low_month(w["monthly_agg"])


def i05_superhost_gap(w):
    return superhost_gaps(w["master"]).select("revpar_gap")


def i06_stale_count(w):
    return stale_count(w["master"])


def i07_pricing_flags(w):
    return pricing_flags(w["master"])


def i08_best_roi(w):
    return best_roi_area(w["master"])


def i09_insight_pack(w):
    return build(w["master"], w["monthly_agg"])


def i10_top_share(w):
    return share_of_top(w["master"])


def i11_under_supplied(w):
    return under_supplied(w["master"])


def i12_growth_before_dip(w):
    return growth_before_dip(library.monthly_revenue(w))


def i13_fragile_leaders(w):
    return fragile_leaders(w["master"])


def i14_underpriced_share(w):
    return underpriced_share(w["master"])


def i15_superhost_gaps(w):
    return superhost_gaps(w["master"])


def i16_stale_share(w):
    return stale_share(w["master"])


def i16_win_back(w):
    return win_back_list(w["master"])


def i17_price_lag(w):
    return price_lag_months(w["monthly_agg"])


def i18_room_mix(w):
    return room_mix_revpar(w["master"])


def s09_report(w):
    return report_lines(build(w["master"], w["monthly_agg"]), market_totals(w["master"]))


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if (name[0] == "i" or name.startswith("s09")) and name[1:3].isdigit()
}
