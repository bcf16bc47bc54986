"""Audits from writes and from shared passes against plain counts, on broken rows and odd keys."""

import collections
import datetime as dt

import pytest

from nightledger.operators import audit, clean, star
from nightledger.plans import library
from nightledger.sources import tables as files


def rows(df):
    return sorted((r.table_name, r.rule, r.violations) for r in df.collect())


def test_counts_of_the_writes_equal_a_pass(w):
    counts = w.counts()
    assert {t: c["rows"] for t, c in counts.items()} == {t: df.count() for t, df in w.tables().items()}
    for report in (audit.range_audit, audit.not_null_audit):
        assert rows(report(w.tables(), counts)) == rows(report(w.tables()))
    perf = w["listing_performance"]
    assert rows(audit.booked_within_tracked(perf, counts)) == rows(audit.booked_within_tracked(perf))
    assert audit.row_counts(w.tables(), counts).first() == audit.row_counts(w.tables()).first()


def found(df, what):
    return df._jdf.queryExecution().executedPlan().toString().count(what)


def scans(df):
    return found(df, "FileScan")


def test_no_table_is_read_for_what_the_writes_counted(w):
    counts = w.counts()
    assert scans(audit.range_audit(w.tables(), counts)) == 0
    assert scans(audit.not_null_audit(w.tables(), counts)) == 0
    assert scans(w.dropped_rows()) == 0
    # each fact once, for its 3 or 4 relationships; each child table once for its references
    assert found(star.star_integrity(w.star()), "Generate explode") == 4
    assert found(audit.reference_audit(w.tables()), "Generate explode") == 6


def test_broken_rows_are_counted_while_written(spark, tmp_path):
    table, counts = audit.watched("listing_performance")
    df = spark.createDataFrame(
        [(1, 10, 12, 1.2, -1.0), (2, None, 1, 0.5, 5.0), (3, 0, None, None, None)],
        "listing_id bigint, total_nights_tracked int, booked_nights int, occupancy_rate double, revenue_estimate double",
    ).repartition(3)
    seen = files.write_stage(df, str(tmp_path / "t"), None, counts)
    assert table == "listing_performance" and spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert {k: v for k, v in seen.items() if v} == {
        "rows": 3,
        "total_nights_tracked > 0": 1,
        "occupancy_rate between 0 and 1": 1,
        "revenue_estimate >= 0": 1,
        "booked_nights <= total_nights_tracked": 1,
        "total_nights_tracked filled": 1,
        "booked_nights filled": 1,
    }
    _, nights = audit.watched("calendar_clean")
    cal = spark.createDataFrame(
        [(1, dt.date(2024, 1, d), True, "2024-01") for d in range(1, 20)] + [(None, None, None, "2024-02")] * 2,
        "listing_id bigint, date date, available boolean, year_month string",
    )
    seen = files.write_stage(cal, str(tmp_path / "n"), "year_month", nights)
    assert seen == {"rows": 21, "listing_id filled": 2, "calendar_date filled": 2, "is_available filled": 2}


def test_orphans_of_odd_keys(frame):
    big = 2**62
    child = frame(
        [(k, t) for k, t in [(1, "a"), (-5, "b"), (-5, "z"), (big, ""), (big + 1, None), (None, "a"), (None, None), (0, "A")]],
        "k bigint, t string",
    )
    numbers = frame([(1,), (-4,), (big,), (None,), (big,)], "id bigint")
    texts = frame([("a",), ("b",), ("",), (None,)], "name string")
    links = [
        ("c", "k in numbers", child, "k", "numbers", numbers, "id"),
        ("c", "t in texts", child, "t", "texts", texts, "name"),
        ("d", "id in numbers", numbers, "id", "numbers", numbers, "id"),
    ]
    # -5 twice, big + 1, 0; z and A; a repeated parent counts once
    assert rows(audit.orphans(links)) == [("c", "k in numbers", 4), ("c", "t in texts", 2), ("d", "id in numbers", 0)]


def test_repeated_keys_and_days(frame, w):
    day = lambda m, d: dt.date(2024, m, d)
    nights = [(1, day(1, 31)), (1, day(1, 31)), (1, day(3, 31)), (2, day(1, 31)), (None, day(1, 1)), (None, day(1, 1)), (1, None), (1, None), (1, None)]
    own = {t: df.limit(0) for t, df in w.tables().items()}
    own["calendar_daily"] = frame([(k, d, 1, None) for k, d in nights], "listing_id bigint, calendar_date date, is_available int, price decimal(10,2)")
    own["neighbourhoods"] = frame([(1, "a", None), (1, "b", None), (None, "b", None), (None, None, None)], "neighbourhood_id bigint, neighbourhood_name string, neighbourhood_group string")
    plain = sum(n - 1 for n in collections.Counter(nights).values())
    got = {(t, r): n for t, r, n in rows(audit.uniqueness_audit(own)) if n}
    assert got == {
        ("calendar_daily", "unique listing_id, calendar_date"): plain,
        ("neighbourhoods", "unique neighbourhood_id"): 2,
        ("neighbourhoods", "unique neighbourhood_name"): 1,
    }


def test_dropped_rows_of_bad_files(spark, frame, tmp_path):
    raw = {
        "listings": frame([(1, "$5"), (1, "$6"), (2, None), (3, "free")], "id int, price string"),
        "calendar": frame([("2024-01-01", "t"), ("soon", "f"), (None, "t"), ("2024-01-02", "?")], "date string, available string"),
        "reviews": frame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "x"), (3, None)], "id int, date string"),
    }
    seen = {t: files.write_stage(df, str(tmp_path / t), None, clean.dropped_counts(t, df)) for t, df in raw.items()}
    got = clean.dropped_rows(spark, seen, {"listings": 1, "reviews": 1})
    assert sorted(tuple(r) for r in got.collect()) == [
        ("calendar", "no date or state", 4, 3),
        ("calendar", "unread date text", 4, 1),
        ("listings", "duplicate id", 2, 1),
        ("listings", "no price", 4, 2),
        ("reviews", "duplicate id", 2, 1),
        ("reviews", "no date", 4, 2),
        ("reviews", "unread date text", 4, 1),
    ]


def test_the_gate_uses_the_counts(w):
    coverage = library.q16_month_coverage(w)
    assert rows(audit.gate_report(w.tables(), coverage, w.counts())) == rows(audit.gate_report(w.tables(), coverage))
    broken = {t: {r: n + (r == "beds >= 0") for r, n in c.items()} for t, c in w.counts().items()}
    with pytest.raises(ValueError, match="beds >= 0"):
        audit.enforce(audit.range_audit(w.tables(), broken))
