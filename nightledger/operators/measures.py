"""Named measures over the star, sliced by any dimension columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.functions.labels import OVERPRICED, UNDERPRICED, WELL_PRICED
from nightledger.functions.numeric import ratio
from nightledger.operators.ranking import global_dense_rank
from nightledger.operators.scalars import with_values
from nightledger.operators.star import RELATIONSHIPS

Where = dict[str, str | list[str]]

CALENDAR = "FactCalendarDaily"
# Date columns that are constant within a month, and those that are not.
MONTH_COLUMNS = ["YearMonth", "Year", "Quarter", "MonthNum", "MonthName"]
DAY_COLUMNS = re.compile(r"\b(Date|DateKey|DayName|IsWeekend)\b")


@dataclass(frozen=True)
class Measure:
    """``parts`` are aggregates over the fact, ``value`` combines them."""

    fact: str
    parts: dict[str, Callable[[], Column]]
    value: Callable[[], Column]
    needs: list[str] = field(default_factory=list)


def _summed(column: str) -> Callable[[], Column]:
    return lambda: F.sum(column)


_REVENUE = {"_revenue": _summed("BookedRevenue")}
_BOOKED = {"_booked": _summed("IsBooked")}
_NIGHTS = {"_nights": _summed("Nights")}


def _calendar(parts: dict, value: Callable[[], Column], needs=()) -> Measure:
    return Measure(CALENDAR, parts, value, list(needs))


def _distinct_listings(fact: str, condition: str | None = None) -> Measure:
    """Listings in a table that has one row per listing (audited by K03): a plain count
    gives the distinct count without shuffling the keys."""
    name = "_listings_" + re.sub(r"\W+", "_", condition or "all")

    def count() -> Column:
        key = F.col("ListingKey")
        return F.count(F.when(F.expr(condition), key) if condition else key)

    return Measure(fact, {name: count}, lambda: F.col(name))


def _total(fact: str, column: str) -> Measure:
    return Measure(
        fact, {f"_sum_{column}": _summed(column)}, lambda: F.col(f"_sum_{column}").cast("double")
    )


def _average(fact: str, column: str) -> Measure:
    parts = {f"_sum_{column}": _summed(column), f"_n_{column}": lambda: F.count(column)}
    return Measure(fact, parts, lambda: ratio(F.col(f"_sum_{column}"), F.col(f"_n_{column}")))


PERFORMANCE, SCORES = "FactListingPerformance", "FactReviewScores"

MEASURES: dict[str, Measure] = {
    "total_revenue": _calendar(_REVENUE, lambda: F.col("_revenue").cast("double")),
    "total_listings": _distinct_listings("DimListing"),
    "avg_occupancy": _calendar(
        _BOOKED | _NIGHTS, lambda: ratio(F.col("_booked"), F.col("_nights"))
    ),
    "adr": _calendar(_REVENUE | _BOOKED, lambda: ratio(F.col("_revenue"), F.col("_booked"))),
    "revpar": _calendar(_REVENUE | _NIGHTS, lambda: ratio(F.col("_revenue"), F.col("_nights"))),
    "pricing_opportunities": _distinct_listings(PERFORMANCE, f"PricingSignal <> '{WELL_PRICED}'"),
    "overpriced_listings": _distinct_listings(PERFORMANCE, f"PricingSignal = '{OVERPRICED}'"),
    "underpriced_listings": _distinct_listings(PERFORMANCE, f"PricingSignal = '{UNDERPRICED}'"),
    "stale_listings": _distinct_listings("DimListing", "IsStaleListing = 1"),
    "avg_estimated_roi": _average(PERFORMANCE, "EstimatedAnnualROIPct"),
    "avg_property_value": _average(PERFORMANCE, "EstimatedPropertyValue"),
    "total_property_value": _total(PERFORMANCE, "EstimatedPropertyValue"),
    "review_count": Measure(
        "FactReviews", {"_reviews": _summed("ReviewCount")}, lambda: F.col("_reviews")
    ),
    "avg_rating": _average(SCORES, "Rating"),
    "avg_cleanliness": _average(SCORES, "Cleanliness"),
    "avg_checkin": _average(SCORES, "Checkin"),
    "avg_communication": _average(SCORES, "Communication"),
    "avg_location": _average(SCORES, "LocationScore"),
    "avg_value": _average(SCORES, "ValueScore"),
}

METRIC_SELECTOR = ["total_revenue", "revpar", "adr", "avg_occupancy"]
GRANULARITIES = ["YearMonth", "Quarter", "Year"]


def _links(fact: str) -> dict[str, tuple[str, str]]:
    """Dimension -> (key in the dimension, key in the fact)."""
    if fact == "DimListing":
        return {"DimListing": ("ListingKey", "ListingKey")}
    return {dim: (key, fact_key) for dim, key, f, fact_key in RELATIONSHIPS if f == fact}


def _split(by: list[str]) -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for item in by:
        dim, column = item.split(".")
        grouped.setdefault(dim, []).append(column)
    return grouped


def _predicates(where: Where, dim: str) -> list[str]:
    given = where.get(dim, [])
    return [given] if isinstance(given, str) else given


def _filtered(members: DataFrame, where: Where, dim: str) -> DataFrame:
    return reduce(DataFrame.where, _predicates(where, dim), members)


def _month_grain(columns: list[str], where: Where) -> bool:
    by_day = any(DAY_COLUMNS.search(p) for p in _predicates(where, "DimDate"))
    return set(columns) <= set(MONTH_COLUMNS) and not by_day


def context(star, fact: str, by: list[str], where: Where, keys: list[str] = ()) -> DataFrame:
    """Fact rows under the filters, with the wanted dimension columns attached.

    A filter keeps only matching rows; a column that is merely shown keeps fact rows
    without a dimension row, under NULL. Calendar questions at month grain read the
    monthly sums.
    """
    links, wanted = _links(fact), _split(by)
    if fact == "DimListing":
        return _filtered(star["DimListing"], where, "DimListing")
    monthly = fact == CALENDAR and _month_grain(wanted.get("DimDate", []), where)
    if monthly:
        rows = star["FactCalendarMonthly"]
        links["DimDate"] = ("YearMonth", "YearMonth")
    elif fact == CALENDAR:
        # "Date" is shown from the date dimension, under the same name
        rows = star[fact].drop("Date").withColumn("Nights", F.lit(1))
    else:
        rows = star[fact]
    for dim, (key, fact_key) in links.items():
        columns = [c for c in wanted.get(dim, []) if c not in rows.columns]
        if not columns and dim not in where:
            continue
        members = star[dim]
        if monthly and dim == "DimDate":
            members = members.select(*MONTH_COLUMNS).distinct()
        members = _filtered(members, where, dim)
        keys = {fact_key: key}
        if dim == "DimDate" and not monthly and fact == CALENDAR:
            # the month lets a date filter skip whole partitions of the nights
            keys["YearMonth"] = "YearMonth"
        members = members.select(*[F.col(k).alias(f"_{f}") for f, k in keys.items()], *columns)
        if dim not in where:
            how = "left"
        else:
            how = "inner" if columns else "left_semi"
        match = [rows[f] == members[f"_{f}"] for f in keys]
        rows = rows.join(members, match, how).drop(*[f"_{f}" for f in keys])
    return rows


def _names(by: list[str]) -> list[str]:
    return [item.split(".")[1] for item in by]


def _additive(star, names: list[str], by: list[str], where: Where) -> DataFrame:
    """Measures of one fact, grouped by the columns its dimensions can supply."""
    measures = {n: MEASURES[n] for n in names}
    fact = next(iter(measures.values())).fact
    parts = {k: build for m in measures.values() for k, build in m.parts.items()}
    grouped = context(star, fact, by, where).groupBy(*_names(by))
    sums = grouped.agg(*[build().alias(k) for k, build in parts.items()])
    return sums.select(*_names(by), *[m.value().alias(n) for n, m in measures.items()])


def _merge(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Put the measures of several facts side by side; a missing key equals itself."""
    if len(frames) == 1:
        return frames[0]
    values = {c: t for f in frames for c, t in f.dtypes if c not in keys}
    padded = [
        f.select(
            *keys,
            *[
                F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c)
                for c, t in values.items()
            ],
        )
        for f in frames
    ]
    stacked = reduce(DataFrame.unionByName, padded)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def evaluate(
    star, measures: list[str], by: list[str] | None = None, where: Where | None = None
) -> DataFrame:
    """Measures grouped by ``Dim.Column`` names under per-dimension SQL predicates.

    ``where`` maps a dimension to one predicate or to a list that must all hold.

    Filters flow from a dimension to its facts only: a fact that has no relation to a
    dimension ignores its filter and repeats its value along its columns.
    """
    by, where = by or [], where or {}
    timed = [m for m in measures if m in TIME_MEASURES]
    shared = "superhost_revenue_share"
    plain = [m for m in measures if m not in TIME_MEASURES and m != shared]
    by_fact: dict[str, list[str]] = {}
    for name in plain:
        by_fact.setdefault(MEASURES[name].fact, []).append(name)
    full, partial = [], []
    for fact, names in by_fact.items():
        usable = [b for b in by if b.split(".")[0] in _links(fact)]
        frame = _additive(star, names, usable, where)
        (full if usable == by else partial).append((usable, frame))
    if timed:
        full.append((by, time_measures(star, timed, by, where)))
    if shared in measures:
        usable = [b for b in by if b != "DimHost.IsSuperhost"]
        frame = superhost_share(star, usable, where)
        (full if usable == by else partial).append((usable, frame))
    if not full:
        raise ValueError("no measure relates to every requested dimension")
    result = _merge([frame for _, frame in full], _names(by))
    for usable, frame in partial:
        result = _attach(result, frame, _names(usable))
    return result.select(*_names(by), *measures)


def _attach(result: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return with_values(result, frame)  # a total
    renamed = frame.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return result.join(renamed, match, "left").drop(*[f"_{k}" for k in keys])


def superhost_share(star, by: list[str], where: Where) -> DataFrame:
    """Superhost revenue over revenue, whatever superhost filter is set.

    Only a predicate on the superhost flag alone can be ignored; one that also names other
    columns of the dimension is refused, so that no other condition is lost with it.
    """
    kept = []
    for predicate in _predicates(where, "DimHost"):
        named = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", predicate)))
        named &= set(star["DimHost"].columns)
        if named > {"IsSuperhost"}:
            raise ValueError("give the superhost filter as a predicate of its own: " + predicate)
        if named != {"IsSuperhost"}:
            kept.append(predicate)
    where = {k: v for k, v in where.items() if k != "DimHost"} | ({"DimHost": kept} if kept else {})
    rows = context(star, CALENDAR, [*by, "DimHost.IsSuperhost"], where)
    keys = _names(by)
    sums = rows.groupBy(*keys).agg(
        F.sum("BookedRevenue").alias("all"),
        F.sum(F.when(F.col("IsSuperhost") == 1, F.col("BookedRevenue"))).alias("super"),
    )
    return sums.select(
        *keys, ratio(F.col("super"), F.col("all")).alias("superhost_revenue_share")
    )


TIME_MEASURES = [
    "revenue_mom_growth",
    "revenue_yoy_growth",
    "revenue_3m_avg",
    "cumulative_revenue",
]


def month_index(year_month: Column) -> Column:
    parts = F.split(year_month, "-")
    return parts[0].cast("int") * 12 + parts[1].cast("int")


#: Months that look back on a month: itself, the next two, and the same one a year later.
LOOKING_BACK = (0, 1, 2, 12)


def time_measures(star, names: list[str], by: list[str], where: Where) -> DataFrame:
    """Growth, trailing average and running total along a month-based date column.

    The fact is summed per month once. RANGE frames over the month index then read the month
    before, the one a year ago and the last three, so gaps in the calendar never shift a
    comparison. The date filter chooses which months are shown and added up; the months they
    are compared with are always taken from the whole calendar. The windows hold one row per
    month of a group.
    """
    dates = [b for b in by if b.startswith("DimDate.")]
    if len(dates) != 1 or not _month_grain(_names(dates), where):
        raise ValueError("time measures need one month-based date column and filter")
    axis = _names(dates)[0]
    others = [b for b in by if b not in dates]
    other_keys = _names(others)
    free = {k: v for k, v in where.items() if k != "DimDate"}
    monthly = (
        context(star, CALENDAR, [*others, "DimDate.YearMonth"], free)
        .groupBy(*other_keys, month_index(F.col("YearMonth")).alias("m"))
        .agg(F.sum("BookedRevenue").alias("current"))
    )
    if axis != "YearMonth":
        # a quarter or year also counts its months without revenue of their own
        spread = F.explode(F.array(*[F.lit(k) for k in LOOKING_BACK])).alias("shift")
        own = F.when(F.col("shift") == 0, F.col("current"))
        monthly = (
            monthly.select("*", spread)
            .groupBy(*other_keys, (F.col("m") + F.col("shift")).alias("m"))
            .agg(F.sum(own).alias("current"))
        )
    along = Window.partitionBy(*other_keys).orderBy("m")

    def between(first: int, last: int) -> Column:
        return F.sum("current").over(along.rangeBetween(first, last))

    compared = monthly.withColumns(
        {"prior": between(-1, -1), "last_year": between(-12, -12), "trailing": between(-2, 0)}
    )
    months = _filtered(star["DimDate"], where, "DimDate")
    labels = [axis] if axis == "YearMonth" else [axis, "YearMonth"]
    months = months.select(*labels).distinct().withColumn("m", month_index(F.col("YearMonth")))
    # the running total is over months within the selection
    seen = compared.join(months, "m").withColumn("running", F.sum("current").over(along))
    keys = [axis if b in dates else b.split(".")[1] for b in by]
    if axis != "YearMonth":
        seen = seen.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("current", "prior", "last_year")],
            *[F.max_by(c, "m").alias(c) for c in ("trailing", "running")],
        )
    shown = seen.where(F.col("current").isNotNull())
    cur, prior, year = F.col("current"), F.col("prior"), F.col("last_year")
    values = {
        "revenue_mom_growth": ratio(cur - prior, prior),
        "revenue_yoy_growth": ratio(cur - year, year),
        "revenue_3m_avg": F.col("trailing").cast("double") / F.lit(3.0),
        "cumulative_revenue": F.col("running").cast("double"),
    }
    return shown.select(*keys, *[values[n].alias(n) for n in names])


def listing_revenue_rank(star, where: Where | None = None) -> DataFrame:
    """Dense revenue rank of the listings in the selection; no revenue counts as 0."""
    where = where or {}
    revenue = (
        context(star, CALENDAR, [], where)
        .groupBy("ListingKey")
        .agg(F.sum("BookedRevenue").alias("rev"))
    )
    members = _filtered(star["DimListing"], where, "DimListing")
    how = "inner" if set(where) - {"DimListing"} else "left"
    ranked = members.select("ListingKey").join(revenue, "ListingKey", how)
    ranked = ranked.select(
        "ListingKey", F.coalesce("rev", F.lit(0)).cast("double").alias("total_revenue")
    )
    return global_dense_rank(ranked, "total_revenue", "revenue_rank", descending=True)


def top_ten_flag(ranked: DataFrame) -> DataFrame:
    """M11."""
    return ranked.withColumn("is_top_10", (F.col("revenue_rank") <= 10).cast("int"))


def neighbourhood_revenue_rank(star, where: Where | None = None) -> DataFrame:
    """Dense revenue rank of the neighbourhoods in the selection."""
    where = where or {}
    revenue = (
        context(star, CALENDAR, [], where)
        .groupBy("NeighbourhoodKey")
        .agg(F.sum("BookedRevenue").alias("rev"))
    )
    members = _filtered(star["DimNeighbourhood"], where, "DimNeighbourhood")
    rows = members.join(revenue, "NeighbourhoodKey", "left").select(
        "NeighbourhoodKey",
        "NeighbourhoodName",
        F.coalesce("rev", F.lit(0)).cast("double").alias("total_revenue"),
    )
    placed = global_dense_rank(rows, "total_revenue", "revenue_rank", descending=True)
    return placed.select("NeighbourhoodName", "total_revenue", "revenue_rank")


def select_metric(star, metric: str, by: list[str], where: Where | None = None) -> DataFrame:
    """One of the selectable metrics, chosen by name."""
    if metric not in METRIC_SELECTOR:
        raise ValueError(f"unknown metric {metric}")
    return evaluate(star, [metric], by, where).withColumnRenamed(metric, "value")


def all_metrics(star, by: list[str], where: Where | None = None) -> DataFrame:
    """All selectable metrics in long form."""
    wide = evaluate(star, METRIC_SELECTOR, by, where)
    return wide.unpivot(_names(by), METRIC_SELECTOR, "metric", "value")


def granularity(name: str) -> str:
    """The date column behind a granularity choice (M29); quarters pool the years."""
    if name not in GRANULARITIES:
        raise ValueError(f"unknown granularity {name}")
    return f"DimDate.{name}"
