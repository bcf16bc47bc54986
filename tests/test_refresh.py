"""Deliveries against full rebuilds, what they read and write, and deliveries that die."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from nightledger.operators import features, refresh, star
from nightledger.operators.refresh import CalendarStore

SCHEMA = "listing_id bigint, calendar_date date, is_available int, price decimal(10,2)"


def frame(spark, rows):
    return spark.createDataFrame([(k, d, a, None if p is None else Decimal(p)) for k, d, a, p in rows], SCHEMA)


@pytest.fixture
def keys(spark):
    return spark.createDataFrame([(i, i % 3, i % 2) for i in range(8)], "listing_id bigint, host_id bigint, neighbourhood_id bigint")


def rebuilt(spark, rows, keys):
    """All three tables from the nights as they stand."""
    nights = frame(spark, rows)
    sums = features.monthly_sums(
        nights.select("listing_id", F.col("calendar_date").alias("date"), (F.col("is_available") == 1).alias("available"), "price")
    )
    return sums, features.listing_metrics(sums), star.fact_calendar_monthly(sums, keys)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda df: sorted(
        (tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.select(*columns).collect()), key=str
    )
    assert plain(a) == plain(b)


def check(spark, store, held, keys):
    rows = [(k, d, a, p) for (k, d), (a, p) in held.items()]
    sums, metrics, fact = rebuilt(spark, rows, keys)
    same(store.monthly(), sums)
    same(store.metrics(), metrics)
    same(store.fact_monthly(), fact)
    same(store.nights().drop("year_month"), frame(spark, rows))


def test_random_deliveries_equal_a_rebuild(spark, tmp_path, keys):
    rnd, held = random.Random(4), {}
    store = CalendarStore(spark, str(tmp_path), keys, buckets=4)
    start = dt.date(2023, 11, 20)
    for number in range(3):
        arriving = {}
        for _ in range(60 if number else 300):
            key = (rnd.randrange(9), start + dt.timedelta(days=rnd.randrange(120)))
            arriving[key] = (rnd.randrange(2), rnd.choice(["0.01", "19.99", "100", None]))
        held |= arriving
        assert store.deliver(frame(spark, [(k, d, a, p) for (k, d), (a, p) in arriving.items()]), f"d{number}")
        check(spark, store, held, keys)


def files(store, table):
    return {os.path.relpath(f.removeprefix("file:").replace("//", "/"), store.path) for f in store._all(table).inputFiles()}


def test_only_touched_months_and_buckets_are_written(spark, tmp_path, keys):
    store = CalendarStore(spark, str(tmp_path), keys, buckets=16)
    days = [dt.date(2024, m, 5) for m in range(1, 7)]
    store.deliver(frame(spark, [(i, d, 0, "10") for i in range(8) for d in days]), "a")
    before = {t: files(store, t) for t in refresh.PARTITION}
    store.deliver(frame(spark, [(1, days[2], 1, "12")]), "b")
    for table in ("nights", "monthly", "fact_monthly"):
        changed = files(store, table) - before[table]
        assert changed and all("/year_month=2024-03/" in f and "number=2" in f for f in changed)
        assert len(before[table] & files(store, table)) > 0
    changed = files(store, "totals") - before["totals"]
    assert len({f.split("/")[2] for f in changed}) == 1
    row = store.metrics().where("id = 1").first()
    assert (row.booked_nights, float(row.revenue_estimate)) == (5, 50.0)


def test_a_delivery_counts_once(spark, tmp_path, keys):
    store = CalendarStore(spark, str(tmp_path), keys)
    rows = [(1, dt.date(2024, 1, 1), 0, "5")]
    assert store.deliver(frame(spark, rows), "a") and not store.deliver(frame(spark, rows), "a")
    assert store.deliver(frame(spark, rows), "again")  # the same nights change nothing
    assert store.metrics().first().booked_nights == 1
    # another session finds what was delivered
    assert CalendarStore(spark, str(tmp_path), keys).monthly().count() == 1


def test_a_delivery_that_dies_changes_nothing(spark, tmp_path, keys, monkeypatch):
    store, day = CalendarStore(spark, str(tmp_path), keys, buckets=2), dt.date(2024, 1, 1)
    store.deliver(frame(spark, [(1, day, 0, "5"), (2, day, 0, "7")]), "a")
    before = sorted(store.monthly().collect())
    write = CalendarStore._write

    def dies(self, table, df, number):
        out = write(self, table, df, number)
        if table == "totals":
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(CalendarStore, "_write", dies)
    second = frame(spark, [(1, day, 0, "6"), (3, day, 1, "1")])
    with pytest.raises(RuntimeError):
        store.deliver(second, "b")
    monkeypatch.setattr(CalendarStore, "_write", write)
    assert sorted(store.monthly().collect()) == before
    assert store.deliver(second, "b")
    check(spark, store, {(1, day): (0, "6"), (2, day): (0, "7"), (3, day): (1, "1")}, keys)


def test_odd_deliveries(spark, tmp_path, keys):
    store, day = CalendarStore(spark, str(tmp_path), keys), dt.date(2024, 1, 1)
    with pytest.raises(ValueError, match="nothing was delivered"):
        store.monthly()
    assert store.deliver(frame(spark, [(None, day, 0, "5"), (1, None, 0, "5"), (1, day, 0, None)]), "a")
    assert store.deliver(frame(spark, []), "empty")
    row = store.monthly().first()
    assert (row.nights_booked, row.booked_revenue) == (1, None)
    assert store.nights().count() == 1


def test_stream_of_deliveries(spark, tmp_path, keys):
    from nightledger.streaming import arrivals

    store = CalendarStore(spark, str(tmp_path / "store"), keys, buckets=2)
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    batches = [[(1, jan, 0, "1"), (2, jan, 0, "2")], [(1, jan, 1, "5"), (1, feb, 0, "3")]]
    for batch in batches:
        rows = frame(spark, batch)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = arrivals.read_arrivals(spark, str(tmp_path / "in"), rows.schema)
        arrivals.deliver_arrivals(stream, store, str(tmp_path / "progress")).awaitTermination()
    check(spark, store, {(1, jan): (1, "5"), (2, jan): (0, "2"), (1, feb): (0, "3")}, keys)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_nights_are_shuffled_as_they_are_and_not_as_sums(spark, tmp_path):
    rows = [(i % 5, dt.date(2024, 1, 1) + dt.timedelta(days=i), i % 2, "1.00") for i in range(100)]
    nights = frame(spark, rows)
    cal = nights.select("listing_id", F.col("calendar_date").alias("date"), (F.col("is_available") == 1).alias("available"), "price")
    sums = features.monthly_sums(cal)
    month = nights.withColumn("year_month", F.date_format("calendar_date", "yyyy-MM"))
    delta = refresh.signed_sums(month)
    for df in (sums, delta):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(listing_id") == shuffles(df) == 1
        assert plan.index("HashAggregate") < plan.index("Exchange")  # none below it
        assert "HashAggregate" not in plan[plan.index("Exchange"):].split("== Initial")[0]


def test_a_first_delivery_merges_nothing(spark, tmp_path, keys, monkeypatch):
    merges = []
    plain = refresh.merged
    monkeypatch.setattr(refresh, "merged", lambda stored, delta, by: merges.append(by) or plain(stored, delta, by))
    store = CalendarStore(spark, str(tmp_path), keys, buckets=4)
    rows = [(1, dt.date(2024, 1, d), d % 2, "10.00") for d in range(1, 9)]
    assert store.deliver(frame(spark, rows), "a") and ["listing_id", "year_month"] not in merges
    # a known month and a new one
    more = [(1, dt.date(2024, 1, 3), 0, "12.00"), (2, dt.date(2024, 2, 1), 0, "7.00")]
    assert store.deliver(frame(spark, more), "b") and ["listing_id", "year_month"] in merges
    held = {(k, d): (a, p) for k, d, a, p in [*rows, *more]}
    check(spark, store, held, keys)
