"""The interactive summary over the master and monthly tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.labels import WELL_PRICED
from nightledger.functions.numeric import ratio, ratio_or_zero
from nightledger.operators.scalars import with_values
from nightledger.plans import insights

# Fixed value: how a missing neighbourhood is shown.
UNSPECIFIED = "Unspecified"


def filter_rows(
    master: DataFrame, neighbourhood: str = "all", room: str = "all", search: str = ""
) -> DataFrame:
    """Neighbourhood, room type and case-insensitive text filter."""
    rows = master
    if neighbourhood != "all":
        rows = rows.where(F.col("neighbourhood_cleansed") == neighbourhood)
    if room != "all":
        rows = rows.where(F.col("room_type") == room)
    if search:
        fields = ["id", "property_type", "host_id", "neighbourhood_cleansed"]
        text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
        rows = rows.where(F.contains(F.lower(text), F.lit(search.lower())))
    return rows


def needs_action():
    return (F.col("pricing_signal") != WELL_PRICED) | F.coalesce("is_stale_listing", F.lit(False))


def filter_choices(master: DataFrame, monthly: DataFrame) -> DataFrame:
    """Values of both filters and the tracked window, in one list."""

    def values(column: str, kind: str) -> DataFrame:
        present = master.where(F.col(column).isNotNull() & (F.col(column) != ""))
        return present.select(F.lit(kind).alias("kind"), F.col(column).alias("value")).distinct()

    months = monthly.agg(F.min("year_month").alias("lo"), F.max("year_month").alias("hi"))
    ends = [
        months.select(F.lit(kind).alias("kind"), F.col(c).alias("value"))
        for kind, c in (("first month", "lo"), ("last month", "hi"))
    ]
    frames = [values("neighbourhood_cleansed", "neighbourhood"), values("room_type", "room type")]
    return reduce(DataFrame.unionByName, frames + ends).orderBy("kind", "value")


def summarize(rows: DataFrame) -> DataFrame:
    """One row of KPIs; zeros when nothing matches."""
    sums = rows.agg(
        F.coalesce(F.sum("revenue_estimate"), F.lit(0)).alias("revenue"),
        F.coalesce(F.sum("booked_nights"), F.lit(0)).alias("booked"),
        F.coalesce(F.sum("total_nights_tracked"), F.lit(0)).alias("tracked"),
        F.count(F.lit(1)).alias("listings"),
        F.count_if(needs_action()).alias("actions"),
    )
    return sums.select(
        "revenue",
        "booked",
        "tracked",
        "listings",
        ratio_or_zero(F.col("booked"), F.col("tracked")).alias("occupancy"),
        ratio_or_zero(F.col("revenue"), F.col("tracked")).alias("revpar"),
        "actions",
    )


def monthly_series(monthly: DataFrame) -> DataFrame:
    """W04."""
    return monthly.groupBy("year_month").agg(F.sum("revenue").alias("revenue")).orderBy("year_month")


def room_mix(rows: DataFrame) -> DataFrame:
    """Count and share per room type, largest first."""
    counts = rows.groupBy("room_type").agg(F.count(F.lit(1)).alias("listings"))
    total = counts.agg(F.sum("listings").alias("total"))
    return (
        with_values(counts, total)
        .select("room_type", "listings", ratio(F.col("listings"), F.col("total")).alias("share"))
        .orderBy(F.desc("listings"), "room_type")
    )


def market_groups(rows: DataFrame) -> DataFrame:
    """Neighbourhood roll-up in which a missing ROI counts as 0."""
    empty = F.col("neighbourhood_cleansed").isNull() | (F.col("neighbourhood_cleansed") == "")
    name = F.when(empty, UNSPECIFIED).otherwise(F.col("neighbourhood_cleansed"))
    roi = F.coalesce("estimated_annual_roi_pct", F.lit(0))
    sums = rows.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("listings"),
        F.coalesce(F.sum("revenue_estimate"), F.lit(0)).alias("revenue"),
        F.coalesce(F.sum("booked_nights"), F.lit(0)).alias("booked"),
        F.coalesce(F.sum("total_nights_tracked"), F.lit(0)).alias("tracked"),
        F.sum(roi).alias("roi_sum"),
    )
    return sums.select(
        "name",
        "listings",
        "revenue",
        "booked",
        "tracked",
        ratio_or_zero(F.col("booked"), F.col("tracked")).alias("occupancy"),
        ratio_or_zero(F.col("revenue"), F.col("tracked")).alias("revpar"),
        ratio(F.col("roi_sum"), F.col("listings")).alias("roi"),
    )


def market_table(rows: DataFrame) -> DataFrame:
    """W07."""
    return market_groups(rows).orderBy(F.desc("revenue"), "name")


def host_comparison(rows: DataFrame) -> DataFrame:
    """Nights-weighted occupancy of superhosts and others; both rows always exist."""
    is_super = F.coalesce("host_is_superhost", F.lit(False))
    sums = rows.agg(
        *[
            F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0)).alias(f"{group}_{column}")
            for group, test in (("s", is_super), ("n", ~is_super))
            for column in ("booked_nights", "total_nights_tracked")
        ]
    )

    def line(label: str, group: str):
        occupancy = ratio_or_zero(
            F.col(f"{group}_booked_nights"), F.col(f"{group}_total_nights_tracked")
        )
        return F.struct(F.lit(label).alias("host_group"), occupancy.alias("occupancy"))

    lines = F.array(line("Superhost", "s"), line("Non-superhost", "n"))
    return sums.select(F.explode(lines).alias("c")).select("c.host_group", "c.occupancy")


def action_queue(rows: DataFrame, n: int = 18) -> DataFrame:
    """Listings to act on, largest pricing gap first."""
    signal = F.col("pricing_signal")
    gap = F.coalesce("pricing_gap", F.lit(0))
    return (
        rows.where(needs_action())
        .select(
            "id",
            "neighbourhood_cleansed",
            "price",
            "adr",
            "pricing_gap",
            F.when(signal != WELL_PRICED, signal).otherwise("Stale review").alias("status"),
        )
        .orderBy(F.abs(gap).desc(), "id")
        .limit(n)
    )


def pick_insight(pack: DataFrame, wanted: str = "EXEC-02") -> DataFrame:
    """The wanted insight, else the first of the pack."""
    return (
        pack.orderBy((F.col("InsightID") != wanted).cast("int"), "position").limit(1)
    ).drop("position")


def w01_filter_choices(w):
    return filter_choices(w["master"], w["monthly_agg"])


def w02_filtered_rows(w):
    rows = filter_rows(w["master"], "NATION_9", "Private room", "econ")
    return rows.select("id", "host_id", "property_type", "neighbourhood_cleansed", "room_type")


def w02_text_search(w):
    return filter_rows(w["master"], search="Nation_1").select("id", "host_id", "property_type")


def w03_kpi_summary(w):
    return summarize(w["master"])


def w03_kpi_summary_filtered(w):
    return summarize(filter_rows(w["master"], room="Hotel room", search="LARGE"))


def w03_kpi_summary_empty(w):
    return summarize(filter_rows(w["master"], search="no such listing"))


def w04_monthly_series(w):
    return monthly_series(w["monthly_agg"])


def w05_room_mix(w):
    return room_mix(w["master"])


def w06_market_groups(w):
    return market_groups(w["master"])


def w07_top_markets(w):
    return market_table(w["master"]).limit(6)


def w07_market_table(w):
    return market_table(w["master"])


def w07_market_table_entire_homes(w):
    return market_table(filter_rows(w["master"], room="Entire home/apt"))


def w08_host_comparison(w):
    return host_comparison(w["master"])


def w09_action_queue(w):
    return action_queue(w["master"])


def w10_headline_insight(w):
    return pick_insight(insights.build(w["master"], w["monthly_agg"]))


QUERIES = {
    name: f for name, f in list(globals().items()) if name[0] == "w" and name[1:3].isdigit()
}
