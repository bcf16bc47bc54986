"""Column helpers on hand-made edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightledger.functions import labels, numeric, parsing
from nightledger.operators import features


def values(frame, inputs, kind, build):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = frame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_price_text(frame):
    texts = ["$1,250.00", " 80 ", "nan", "None", "<NA>", "", "£90", "abc", None]
    expected = [1250.0, 80.0, None, None, None, None, None, None, None]
    assert values(frame, texts, "string", parsing.parse_price) == expected
    assert values(frame, [12.5], "double", parsing.parse_price) == [12.5]


def test_percent_text(frame):
    assert values(frame, ["95%", "N/A", None], "string", parsing.parse_percent) == [95.0, None, None]


def test_dates(frame):
    texts = ["2020-02-29", "2020-13-01", None]
    assert values(frame, texts, "string", parsing.parse_date) == [dt.date(2020, 2, 29), None, None]
    texts = ["01/02/2025", "Jan 2, 2025", "January 2, 2025", "2025/01/02", "20250102", " 1-2-2025 "]
    assert values(frame, texts, "string", parsing.parse_date) == [dt.date(2025, 1, 2)] * len(texts)
    assert values(frame, ["13/13/2025", "soon", ""], "string", parsing.parse_date) == [None] * 3


def test_flags(frame):
    texts = ["t", "f", "T", "true", None]
    assert values(frame, texts, "string", parsing.parse_flag) == [True, False, None, None, None]


def test_first_number(frame):
    texts = ["1.5 shared baths", "Half-bath", "2 baths", None]
    assert values(frame, texts, "string", parsing.first_number) == [1.5, None, 2.0, None]


def test_strip_breaks(frame):
    texts = ["a<br/>b<br >c", " \n\tx<br> ", None]
    assert values(frame, texts, "string", parsing.strip_breaks) == ["a b c", "x", None]


def test_amenity_count(frame):
    texts = ["[]", '["a", "b"]', None, '["a, b"]']
    assert values(frame, texts, "string", parsing.amenity_count) == [1, 2, 0, 2]


def test_upper_clip(frame):
    build = lambda c: numeric.upper_clip(c, 365)
    assert values(frame, [1000, 30, None], "int", build) == [365, 30, None]


def test_experience_tier(frame):
    new, growing, established, veteran = labels.EXPERIENCE_TIERS
    years = [0.0, 1.0, 1.1, 3.0, 6.0, 6.1, -1.0, 101.0, None]
    expected = [new, new, growing, growing, established, veteran, None, None, None]
    assert values(frame, years, "double", labels.experience_tier) == expected


@pytest.mark.parametrize("option, never", [(False, False), (True, True)])
def test_stale(frame, option, never):
    build = lambda c: features.stale_flag(c, option)
    assert values(frame, [365, 366, None], "int", build) == [False, True, never]


def test_composite_score(frame):
    df = frame(
        [(4.0, 5.0, None, 3.0, 4.0), (None, None, None, None, None)],
        "a double, b double, c double, d double, e double",
    )
    score = features.composite_score([F.col(c) for c in "abcde"])
    assert [r[0] and float(r[0]) for r in df.select(score).collect()] == [4.0, None]


def test_pricing_signal(frame):
    gaps = [20.0, 20.01, -20.0, -20.01, None]
    expected = [
        labels.WELL_PRICED,
        labels.OVERPRICED,
        labels.WELL_PRICED,
        labels.UNDERPRICED,
        labels.WELL_PRICED,
    ]
    assert values(frame, gaps, "double", labels.pricing_signal) == expected


def test_percentage_signal(frame):
    df = frame([(20.0, 50.0), (20.0, 500.0), (-30.0, 100.0), (5.0, 0.0)], "g double, p double")
    out = [r[0] for r in df.select(labels.pricing_signal_pct(F.col("g"), F.col("p"))).collect()]
    assert out == [labels.OVERPRICED, labels.WELL_PRICED, labels.UNDERPRICED, labels.WELL_PRICED]


def test_half_even(frame):
    build = lambda c: numeric.half_even(c, 2)
    given = [0.125, 0.375, 2.5, -0.125, -0.375, 1 / 32, None]
    assert values(frame, given, "double", build) == [0.12, 0.38, 2.5, -0.12, -0.38, 0.03, None]
    whole = lambda c: numeric.half_even(c, 0)
    assert values(frame, [0.5, 1.5, 2.5, -0.5, -1.5], "double", whole) == [0.0, 2.0, 2.0, 0.0, -2.0]


def test_half_away(frame):
    build = lambda c: numeric.half_away(c, 2)
    given = [0.125, 2.5, -0.125, -0.375, -0.001, None]
    out = values(frame, given, "double", build)
    assert out == [0.13, 2.5, -0.13, -0.38, 0.0, None]
    assert str(out[4]) == "0.0"


def test_ties_of_the_key_figures(frame):
    df = frame([(1, 32, 0.04), (5, 32, 0.2)], "booked int, tracked int, rev double")
    booked, tracked, rev = F.col("booked"), F.col("tracked"), F.col("rev")
    out = df.select(
        features.occupancy(booked, tracked).cast("double"),
        features.per_night(rev * 3.125, booked).cast("double"),
    ).collect()
    # 0.03125 and 0.15625 to four places; 0.125 and 0.125 to the cent
    assert [tuple(r) for r in out] == [(0.0312, 0.12), (0.1562, 0.12)]


def test_per_night(frame):
    df = frame([(0, 10, 0.0), (4, 10, 500.0)], "booked int, tracked int, rev double")
    booked, tracked, rev = F.col("booked"), F.col("tracked"), F.col("rev")
    out = df.select(
        features.occupancy(booked, tracked).cast("double"),
        features.per_night(rev, booked).cast("double"),
        features.per_night(rev, tracked).cast("double"),
    ).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0, 0.0), (0.4, 125.0, 50.0)]
