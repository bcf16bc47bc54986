"""Every registered query against its SQL, and properties across queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from nightledger.operators import audit, measures
from nightledger.plans import library, registry, summary
from tests.compare import compare, connect
from tests.conftest import SF_DIR

# The training-data operators have their own tests.
QUERIES = {k: v for k, v in entry_points.queries().items() if k in registry.all_queries()}
SQL = {k: v for k, v in entry_points.oracle_sql().items() if k in QUERIES}
# Result may be empty on the smallest data.
MAY_BE_EMPTY = {
    "i16_win_back",
    "v12_drill_neighbourhood",
    "v18_new_hosts",
    "v24_sliced_trend",
    "w02_filtered_rows",
}


@pytest.fixture(scope="session")
def con():
    return connect(SF_DIR)


# Numbers of a fitted forest; tests/test_forest.py checks them in another engine.
WITHOUT_SQL = {"l06_forest_metrics", "l08_importance_weights"}


def test_sql_for_all_other_queries():
    assert set(SQL) == set(QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    problems = compare(QUERIES[name](spark, SF_DIR), con, SQL[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


def test_entry(spark):
    assert 0 < entry_points.entry(spark).count() <= 15


def test_known_totals(w):
    """Counts that were worked out separately for this data."""
    assert w["raw_listings"].count() == 205
    assert w["listings_clean"].count() == 197
    assert w["raw_calendar"].count() == 5967
    row = w["master"].agg(
        F.sum("revenue_estimate").cast("decimal(18,2)").cast("string").alias("revenue"),
        F.sum("booked_nights").alias("booked"),
        F.sum("total_nights_tracked").alias("tracked"),
    ).first()
    assert (row.revenue, row.booked, row.tracked) == ("557484.69", 1932, 5870)
    signals = {r.pricing_signal: r["count"] for r in w["master"].groupBy("pricing_signal").count().collect()}
    assert signals == {"Possibly Overpriced": 54, "Possibly Underpriced": 2, "Well-Priced": 141}
    risk = {r.risk_level: r.num_listings for r in library.q14_risk_levels(w).collect()}
    assert risk == {"High Risk": 46, "Moderate Risk": 86, "Healthy": 65}
    assert library.q16_month_coverage(w).where("coverage_status = 'MISSING'").count() == 0
    assert library.q05_declining_occupancy(w).count() == 81


def test_revenue_agrees_at_every_grain(w):
    nights = w["fact_calendar"].agg(F.sum("BookedRevenue")).first()[0]
    months = w["fact_calendar_monthly"].agg(F.sum("BookedRevenue")).first()[0]
    by_month = measures.evaluate(w.star(), ["total_revenue"], ["DimDate.YearMonth"])
    assert nights == months
    assert by_month.agg(F.sum("total_revenue")).first()[0] == pytest.approx(float(nights))
    known = w["fact_calendar"].where("HostKey IS NOT NULL").agg(F.sum("BookedRevenue")).first()[0]
    listed = w["listing_performance"].agg(F.sum("revenue_estimate")).first()[0]
    # a night filled with a median of half a cent is rounded in the daily table only
    assert float(known) == pytest.approx(float(listed), abs=1.0)


def test_bounds_and_shares(w):
    perf = w["listing_performance"]
    assert perf.where("booked_nights > total_nights_tracked").count() == 0
    assert perf.where("occupancy_rate < 0 OR occupancy_rate > 1").count() == 0
    product = F.abs(F.col("occupancy_rate") * F.col("adr") - F.col("revpar"))
    assert perf.where(product > 0.1).count() == 0
    shares = summary.room_mix(w["master"]).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)


def test_running_total_ends_at_the_total(w):
    rows = library.q09_running_revenue(w).collect()
    totals, last = {}, {}
    for r in rows:
        totals[r.neighbourhood_name] = totals.get(r.neighbourhood_name, 0) + r.month_revenue
        last[r.neighbourhood_name] = r.cumulative_revenue
    assert totals == last


def test_partitioning_does_not_change_results(spark, w):
    from nightledger.operators import clean

    cal = w["raw_calendar"]
    once = clean.clean_calendar(cal.repartition(1))
    many = clean.clean_calendar(cal.repartition(13, "price"))
    assert once.exceptAll(many).count() == 0 and many.exceptAll(once).count() == 0
    raw = w["raw_listings"]
    a = clean.clean_listings(raw.repartition(1), ["copy"])
    b = clean.clean_listings(raw.repartition(11), ["copy"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture
def gap(spark):
    """Months of a calendar that lacks February 1998."""
    months = [("1997-12", 100.0), ("1998-01", 200.0), ("1998-03", 300.0)]
    return {"fact_calendar_monthly": spark.createDataFrame(months, "YearMonth string, BookedRevenue double")}


def test_a_missing_month_is_reported(w, gap):
    coverage = library.q16_month_coverage(gap)
    assert [tuple(r) for r in coverage.collect()] == [
        ("1997-12", "Present"),
        ("1998-01", "Present"),
        ("1998-02", "MISSING"),
        ("1998-03", "Present"),
    ]
    report = audit.gate_report(w.tables(), coverage).where("rule = 'every month covered'")
    assert report.first().violations == 1
    with pytest.raises(ValueError, match="every month covered"):
        audit.enforce(report)


def test_growth_over_a_missing_month(gap):
    last_present = {r.yr_month: r.mom_growth_pct for r in library.q04_month_over_month(gap).collect()}
    previous = {r.yr_month: r.mom_growth_pct for r in library.q21_month_over_month_join(gap).collect()}
    assert last_present == {"1997-12": None, "1998-01": 100.0, "1998-03": 50.0}
    assert previous == {"1997-12": None, "1998-01": 100.0, "1998-03": None}


def test_quality_gate_raises(w):
    report = audit.range_audit(w.tables())
    audit.enforce(report)
    broken = report.withColumn("violations", F.lit(2))
    with pytest.raises(ValueError, match="quality gate"):
        audit.enforce(broken)


@pytest.fixture(scope="session")
def area(w):
    return w["neighbourhoods"].agg(F.max("neighbourhood_name")).first()[0]


def test_slicers_reach_every_fact(w, area):
    star = w.star()
    where = {"DimNeighbourhood": f"NeighbourhoodName = '{area}'"}
    names = ["total_revenue", "review_count", "avg_rating", "avg_estimated_roi"]
    one = measures.evaluate(star, names, [], where).first()
    rows = measures.evaluate(star, names, ["DimNeighbourhood.NeighbourhoodName"]).collect()
    wanted = next(r for r in rows if r.NeighbourhoodName == area)
    assert tuple(one) == tuple(wanted)[1:]


def test_unrelated_filters_are_ignored(w):
    star = w.star()
    plain = measures.evaluate(star, ["avg_rating", "total_listings"]).first()
    dated = measures.evaluate(star, ["avg_rating", "total_listings"], [], {"DimDate": "Year = 1996"})
    assert tuple(plain) == tuple(dated.first())


def test_superhost_share_ignores_its_own_filter(w):
    star = w.star()
    plain = measures.evaluate(star, ["superhost_revenue_share"]).first()[0]
    filtered = measures.evaluate(
        star, ["superhost_revenue_share"], [], {"DimHost": "IsSuperhost = 1"}
    ).first()[0]
    assert plain == filtered
    tier = "ExperienceTier <> 'none'"
    kept = measures.evaluate(
        star, ["superhost_revenue_share"], [], {"DimHost": ["IsSuperhost = 1", tier]}
    ).first()[0]
    known = measures.evaluate(star, ["superhost_revenue_share"], [], {"DimHost": tier}).first()[0]
    assert kept == known
    by_status = measures.evaluate(
        star, ["total_revenue", "superhost_revenue_share"], ["DimHost.IsSuperhost"]
    ).collect()
    assert {r.superhost_revenue_share for r in by_status} == {plain}


def test_superhost_share_keeps_the_other_conditions(w):
    star, names = w.star(), ["superhost_revenue_share"]
    tier = "ExperienceTier = 'Growing (1-3yr)'"
    listed = measures.evaluate(star, names, [], {"DimHost": ["IsSuperhost = 1", tier]}).first()[0]
    alone = measures.evaluate(star, names, [], {"DimHost": tier}).first()[0]
    assert listed == alone != measures.evaluate(star, names).first()[0]
    with pytest.raises(ValueError, match="predicate of its own"):
        measures.evaluate(star, names, [], {"DimHost": f"IsSuperhost = 1 AND {tier}"})
    quoted = measures.evaluate(star, names, [], {"DimHost": "ExperienceTier <> 'IsSuperhost'"})
    assert quoted.first()[0] is not None


def test_rank_within_a_selection(w, area):
    ranked = measures.listing_revenue_rank(
        w.star(), {"DimNeighbourhood": f"NeighbourhoodName = '{area}'"}
    )
    rows = ranked.orderBy(F.desc("total_revenue")).collect()
    assert rows[0].revenue_rank == 1 and len(rows) < w["listings"].count()


def test_day_filters_need_plain_measures(w):
    with pytest.raises(ValueError):
        measures.evaluate(
            w.star(), ["revenue_mom_growth"], ["DimDate.YearMonth"], {"DimDate": "DayName = 'Monday'"}
        )
