"""Date dimension, month comparisons, ranks, loads and the model on hand-made tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from nightledger.operators import incremental, measures, normalize, pricing_model, star
from nightledger.plans import library, summary
from nightledger.streaming import arrivals


def test_dim_date(frame):
    span = frame([(dt.date(2024, 5, 6), dt.date(2024, 5, 6))], "first_night date, last_night date")
    rows = {r.DateKey: r for r in star.dim_date(span).collect()}
    assert len(rows) == 15
    day = rows["20240506"]
    assert (day.DayName, day.IsWeekend, day.Quarter, day.YearMonth) == ("Monday", False, 2, "2024-05")
    assert rows["20240511"].IsWeekend and rows["20240512"].IsWeekend


class Tables(dict):
    """A warehouse made of given frames."""

    def star(self):
        return self


def small_star(spark, nights, listings=(1, 2, 3, 4)):
    """nights: (listing, date, price, booked)."""
    rows = [(k, d, Decimal(p), b) for k, d, p, b in nights]
    fact = spark.createDataFrame(
        rows, "ListingKey bigint, Date date, Price decimal(10,2), IsBooked int"
    ).select(
        "*",
        F.when(F.col("IsBooked") == 1, F.col("Price")).otherwise(Decimal(0)).alias("BookedRevenue"),
        F.date_format("Date", "yyyyMMdd").alias("DateKey"),
        F.lit(1).cast("bigint").alias("HostKey"),
        F.lit(1).cast("bigint").alias("NeighbourhoodKey"),
    )
    span = fact.agg(F.min("Date").alias("first_night"), F.max("Date").alias("last_night"))
    sums = fact.groupBy(
        F.col("ListingKey").alias("id"), F.date_format("Date", "yyyy-MM").alias("year_month")
    ).agg(
        F.sum("BookedRevenue").alias("booked_cents"),
        F.sum("IsBooked").alias("nights_booked"),
        F.count(F.lit(1)).alias("nights_tracked"),
    )
    owners = spark.createDataFrame(
        [(k, 1, 1) for k in listings], "listing_id bigint, host_id bigint, neighbourhood_id bigint"
    )
    monthly = star.fact_calendar_monthly(sums, owners)
    return Tables(
        DimDate=star.dim_date(span),
        DimListing=spark.createDataFrame([(k,) for k in listings], "ListingKey bigint"),
        FactCalendarDaily=fact,
        FactCalendarMonthly=monthly,
        fact_calendar_monthly=monthly,
    )


@pytest.fixture(scope="module")
def gap_star(spark):
    """Months 01, 02, 04 with revenue 30, 60, 90."""
    nights = [
        (1, dt.date(2024, 1, 5), "30", 1),
        (1, dt.date(2024, 2, 5), "60", 1),
        (1, dt.date(2024, 4, 5), "90", 1),
        (1, dt.date(2024, 4, 6), "500", 0),
    ]
    return small_star(spark, nights)


def test_lag_and_calendar_months_differ_over_a_gap(gap_star):
    lagged = {r.yr_month: r for r in library.q04_month_over_month(gap_star).collect()}
    assert lagged["2024-04"].prior_month_revenue == 60 and lagged["2024-04"].mom_growth_pct == 50.0
    rows = measures.evaluate(gap_star, ["revenue_mom_growth"], ["DimDate.YearMonth"]).collect()
    growth = {r.YearMonth: r.revenue_mom_growth for r in rows}
    assert growth == {"2024-01": None, "2024-02": 1.0, "2024-04": None}
    joined = {r.yr_month: r for r in library.q21_month_over_month_join(gap_star).collect()}
    assert joined["2024-04"].prior_month_revenue is None


def test_trailing_average_always_divides_by_three(gap_star):
    rows = measures.evaluate(gap_star, ["revenue_3m_avg"], ["DimDate.YearMonth"]).collect()
    assert {r.YearMonth: r.revenue_3m_avg for r in rows} == {
        "2024-01": 10.0,
        "2024-02": 30.0,
        "2024-04": 50.0,
    }


def test_running_total_within_a_selection(gap_star):
    rows = measures.evaluate(
        gap_star, ["cumulative_revenue"], ["DimDate.YearMonth"], {"DimDate": "YearMonth >= '2024-02'"}
    ).collect()
    assert {r.YearMonth: r.cumulative_revenue for r in rows} == {"2024-02": 60.0, "2024-04": 150.0}


def test_missing_months(gap_star):
    rows = library.q16_month_coverage(gap_star).collect()
    assert [(r.expected_month, r.coverage_status) for r in rows] == [
        ("2024-01", "Present"),
        ("2024-02", "Present"),
        ("2024-03", "MISSING"),
        ("2024-04", "Present"),
    ]


def test_dense_rank_counts_listings_without_revenue(spark):
    nights = [(k, dt.date(2024, 1, 1), p, 1) for k, p in ((1, "100"), (2, "100"), (3, "50"))]
    rows = measures.listing_revenue_rank(small_star(spark, nights)).collect()
    assert {r.ListingKey: r.revenue_rank for r in rows} == {1: 1, 2: 1, 3: 2, 4: 3}


@pytest.mark.parametrize("occupied, expected", [((9, 6, 3), 1), ((9, 6, 6), 0)])
def test_two_declines_in_a_row(spark, occupied, expected):
    nights = [
        (1, dt.date(2024, month, day), "10", int(day <= n))
        for month, n in enumerate(occupied, 1)
        for day in range(1, 11)
    ]
    assert library.q05_declining_occupancy(small_star(spark, nights)).count() == expected


def test_missing_neighbourhood_gets_its_own_key(frame):
    master = frame(
        [(1, "B", "G"), (2, None, None), (3, "A", "G"), (4, "B", "F")],
        "id bigint, neighbourhood_cleansed string, neighbourhood_group_cleansed string",
    )
    dim = normalize.neighbourhoods(master)
    keyed = normalize.with_neighbourhood_id(master, dim).collect()
    assert {r.id: r.neighbourhood_id for r in keyed} == {1: 2, 2: 3, 3: 1, 4: 2}


def test_hosts_take_their_lowest_listing(frame):
    master = frame(
        [(2, 7, False, "b"), (1, 7, None, "a"), (3, 8, True, "c")],
        "id bigint, host_id bigint, host_is_superhost boolean, host_response_time string",
    )
    rows = {r.host_id: r for r in normalize.hosts(master).collect()}
    assert (rows[7].response_time, rows[7].is_superhost, rows[8].is_superhost) == ("a", 0, 1)


def test_missing_roi_counts_as_zero_on_the_page(frame):
    from nightledger.plans import insights

    rows = frame(
        [(1, "A", 10.0, 1, 2, 10.0, 4.0), (2, "A", 0.0, 0, 0, None, 5.0), (3, None, 5.0, 1, 1, 2.0, 4.0)],
        "id int, neighbourhood_cleansed string, revenue_estimate double, booked_nights int, "
        "total_nights_tracked int, estimated_annual_roi_pct double, review_score_composite double",
    )
    page = {r.name: r.roi for r in summary.market_groups(rows).collect()}
    assert page == {"A": 5.0, "Unspecified": 2.0}
    pack = {r.neighbourhood_cleansed: r.avg_roi for r in insights.neighbourhood_rollup(rows).collect()}
    assert pack == {"A": 10.0, None: 2.0}


def night_rows(spark, rows):
    df = spark.createDataFrame(
        [(k, d, 1, Decimal(p)) for k, d, p in rows],
        "listing_id bigint, calendar_date date, is_available int, price decimal(10,2)",
    )
    return df.withColumn("year_month", F.date_format("calendar_date", "yyyy-MM"))


def test_upsert_touches_only_its_months(spark, tmp_path):
    path = str(tmp_path / "nights")
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    first = night_rows(spark, [(1, jan, "1"), (2, jan, "2"), (1, feb, "3")])
    second = night_rows(spark, [(1, jan, "9"), (3, jan, "4")])
    for arrival in (first, second, second):
        incremental.upsert_nights(spark, path, arrival)
    rows = spark.read.schema(first.schema).parquet(path).collect()
    got = {(r.listing_id, r.calendar_date): int(r.price) for r in rows}
    assert got == {(1, jan): 9, (2, jan): 2, (3, jan): 4, (1, feb): 3}


def test_stream_of_arrivals(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    batches = [[(1, jan, "1"), (2, jan, "2")], [(1, jan, "5"), (1, feb, "3")]]
    schema = None
    for batch in batches:
        rows = night_rows(spark, batch).drop("year_month")
        schema = rows.schema
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = arrivals.read_arrivals(spark, source, schema)
        arrivals.load_arrivals(stream, target, str(tmp_path / "progress")).awaitTermination()
    rows = spark.read.parquet(target).collect()
    got = {(r.listing_id, r.calendar_date): int(r.price) for r in rows}
    assert got == {(1, jan): 5, (2, jan): 2, (1, feb): 3}


def test_newest_snapshot_wins(spark):
    day = dt.date(2024, 1, 1)
    old, new = night_rows(spark, [(1, day, "1"), (2, day, "2")]), night_rows(spark, [(1, day, "7")])
    rows = incremental.combine_snapshots({"2024-01-01": old, "2024-02-01": new}).collect()
    assert {(r.listing_id, int(r.price), str(r.snapshot_date)) for r in rows} == {
        (1, 7, "2024-02-01"),
        (2, 2, "2024-01-01"),
    }


def test_weeks_start_on_monday(spark):
    nights = night_rows(spark, [(1, dt.date(2024, 5, 5), "1"), (1, dt.date(2024, 5, 6), "2")])
    weeks = {r.week_start for r in incremental.weekly_rollup(nights).collect()}
    assert weeks == {dt.date(2024, 4, 29), dt.date(2024, 5, 6)}


def test_price_model(spark, w, tmp_path):
    numeric, categorical = pricing_model.usable_features(w["master"])
    assert not set(numeric + categorical) & set(pricing_model.LEAKING)
    df = pricing_model.feature_frame(w["master"], numeric, categorical)
    train, test = pricing_model.split(df)
    again, _ = pricing_model.split(df.repartition(9))
    assert train.count() + test.count() == df.count()
    assert train.select("id").exceptAll(again.select("id")).count() == 0
    forest = pricing_model.forest_model(trees=5, depth=4)
    model = pricing_model.fit(train, numeric, categorical, forest)
    unseen = test.withColumn("room_type", F.lit("Treehouse")).withColumn("beds", F.lit(None).cast("double"))
    scored = model.transform(unseen)
    assert all(sum(r.room_type_onehot.toArray()) == 0 for r in scored.select("room_type_onehot").collect())
    result = pricing_model.metrics("forest", model.transform(test)).first()
    assert result.n == test.count() and result.rmse >= result.mae > 0
    top = pricing_model.importances(spark, model, scored).collect()
    assert len(top) == 15 and any("=" in r.feature or r.feature in numeric for r in top)
    path = str(tmp_path / "model")
    pricing_model.save(model, path)
    prices = pricing_model.suggest_price(path, df.drop("price"))
    assert prices.where("suggested_price IS NULL").count() == 0


def test_mode_breaks_ties_downwards(frame):
    df = frame([("b", "x"), ("a", "x"), (None, "y"), ("b", None), ("a", None)], "p string, q string")
    modes = {r.name: r.value for r in pricing_model.most_frequent(df, ["p", "q"]).collect()}
    assert modes == {"p": "a", "q": "x"}
