"""What stages shuffle and write: nights stay with their listing, few keys are broadcast."""

import datetime as dt

from pyspark.sql import functions as F

from nightledger.operators import audit, clean, features, ranking
from nightledger.plans.warehouse import Warehouse

DAY = dt.datetime(2001, 5, 1)


def given(spark, folder):
    """Sixty lines of six parts, one of them in two rows, with orders, customers and a repeated document."""
    lines = [
        (i // 2, i % 6 + 40, 1, i % 3 + 1, "R" if i % 4 else "A", 5.0, 100.0, 0.02 * (i % 5), 0.01 * (i % 7), DAY + dt.timedelta(days=i % 45))
        for i in range(60)
    ]
    parts = [(p, 900.0 + p, p % 9, "TYPE") for p in (*range(40, 46), 41)]
    rows = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"),
        "part": (parts, "p_partkey long, p_retailprice double, p_size int, p_type string"),
        "orders": ([(i, 1 + i % 2, DAY) for i in range(30)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "customer": ([(1, "Ann"), (2, "Bo"), (2, "Bo too")], "c_custkey long, c_name string"),
        "documents": ([(0, "a"), (1, "b"), (1, "c")], "doc_id long, text string"),
        "supplier": ([(1, 3, 5500.0)], "s_suppkey long, s_nationkey long, s_acctbal double"),
        "nation": ([(3, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "region": ([(0, "R")], "r_regionkey long, r_name string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(folder / f"{name}.parquet"))
    return Warehouse.of_tables(spark, str(folder))


def rows(df):
    return sorted(map(str, df.collect()))


def test_metrics_need_neither_raw_nights_nor_months(spark, tmp_path):
    w = given(spark, tmp_path)
    from_nights = rows(w["metrics"])
    written = set(w._stages) - w.UNWRITTEN
    assert not written & {"raw_calendar", "monthly", "calendar_clean"}
    assert {"calendar_typed", "calendar_gaps"} <= written
    from_months = features.listing_metrics(features.monthly_sums(w["calendar_clean"]))
    assert from_nights == rows(from_months) and len(from_nights) == 6
    assert "open_price_sum" not in w["monthly"].columns


def test_a_listing_lies_in_one_part_of_the_typed_nights(spark, tmp_path):
    w = given(spark, tmp_path)
    places = w["calendar_typed"].select("listing_id", F.input_file_name().alias("file")).distinct()
    assert places.count() == places.select("listing_id").distinct().count() == 6


def test_nights_are_the_same_from_the_raw_stage(spark, tmp_path):
    w = given(spark, tmp_path)
    without = rows(w["calendar_clean"])
    again = Warehouse.of_tables(spark, str(tmp_path))
    again["raw_calendar"]
    assert rows(again["calendar_clean"]) == without
    whole = clean.clean_typed_calendar(w["calendar_typed"])
    assert rows(whole) == rows(w["calendar_clean"].drop("year_month"))
    assert w.counts()["calendar_daily"]["rows"] == len(without)


def test_listings_count_written_reviews_once(spark, tmp_path):
    alone = given(spark, tmp_path)
    own = rows(alone["raw_listings"])
    assert "review_rows" not in alone._stages
    again = Warehouse.of_tables(spark, str(tmp_path))
    again.tables()
    assert rows(again["raw_listings"]) == own


def test_repeated_keys_are_joined_by_shuffle_beyond_the_bound(frame, monkeypatch):
    df = frame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c"), (None, 2, "e"), (None, 1, "d")], "id int, n int, t string")
    want = ["d", "a", "c"]
    for most in (ranking.BROADCAST_KEYS, 0):
        monkeypatch.setattr(ranking, "BROADCAST_KEYS", most)
        for first in (
            ranking.first_per_key_placed(df, ["id"], ["n"]),
            ranking.first_per_key_wide(df, ["id"], [F.col("n").asc()]),
        ):
            assert [r.t for r in first.orderBy("id").collect()] == want


def test_days_of_a_year_are_bits_of_few_numbers(frame):
    year = [DAY.date().replace(month=1, day=1, year=2000) + dt.timedelta(days=i) for i in range(500)]
    twice = [year[0], year[61], year[62], year[365], year[366], year[366], None, None]
    nights = frame([(7, d) for d in year] + [(7, d) for d in twice] + [(None, year[3])] * 2, "id int, d date")
    found = audit._repeated_days(nights, ["id"], "d")
    # six days again and one missing day, and one more of the listing that is missing
    assert found.agg(F.sum("violations")).first()[0] == 6 + 1 + 1
    # a row per listing and year, and one for the missing days
    assert found.count() == 4
