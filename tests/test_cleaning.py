"""Cleaning and features on small hand-made tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightledger.operators import clean, features
from nightledger.sources import files, tables


def test_required_columns(frame):
    df = frame([(1, "2024-01-01")], "listing_id int, date string")
    with pytest.raises(ValueError, match="available"):
        clean.clean_calendar(df)


def test_no_price_at_all(frame):
    df = frame([("1", "2024-01-01", "t")], "listing_id string, date string, available string")
    with pytest.raises(ValueError, match="price"):
        clean.clean_calendar(df)


def test_keep_present(frame):
    kept, missing = clean.keep_present(frame([(1, 2)], "a int, z int"), ["a", "b"])
    assert (kept.columns, missing) == (["a"], ["b"])


def test_iqr_cap(frame):
    df = frame([(v,) for v in (10.0, 20.0, 30.0, 40.0, 1000.0, None)], "price double")
    bounds = clean.iqr_bounds(df, "price").first()
    assert (float(bounds.low), float(bounds.high)) == (0.0, 70.0)
    out = sorted(float(r[0]) for r in clean.cap_iqr(df, "price").dropna().collect())
    assert out == [10.0, 20.0, 30.0, 40.0, 70.0]
    assert clean.cap_iqr(df, "price").where("price IS NULL").count() == 1


def raw_listing(**changes):
    base = {
        "id": "1",
        "host_id": "9",
        "host_since": "2020-01-01",
        "host_is_superhost": "t",
        "host_response_rate": "95%",
        "price": "$100.00",
        "bathrooms_text": "1.5 baths",
        "bedrooms": "2",
        "minimum_nights": "1000",
        "amenities": "[]",
        "copy": 1,
    }
    return {**base, **changes}


def listings(spark, *rows):
    names = list(raw_listing())
    schema = ", ".join(f"{c} {'int' if c == 'copy' else 'string'}" for c in names)
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)


def test_second_copy_survives_an_unpriced_first(spark):
    raw = listings(
        spark,
        raw_listing(price=None),
        raw_listing(copy=2, price="$80.00", host_response_rate="N/A", host_is_superhost=None),
        raw_listing(id="2", bedrooms=None, price="$90.00"),
    )
    out = {r.id: r for r in clean.clean_listings(raw, ["copy"]).collect()}
    assert set(out) == {1, 2}
    first = out[1]
    assert (float(first.price), first.host_response_rate, first.host_is_superhost) == (80, 0, False)
    assert first.host_response_rate_missing and first.minimum_nights == 365
    assert first.bathrooms == 1.5 and out[2].bedrooms == 2.0
    assert "copy" not in first.asDict()


def test_bathroom_text_is_ignored_when_the_number_exists(spark):
    raw = listings(spark, raw_listing()).withColumn("bathrooms", F.lit("3"))
    assert clean.clean_listings(raw, ["copy"]).first().bathrooms == 3.0


def nights(frame, rows):
    return frame(rows, "listing_id string, date string, available string, price string")


def test_night_price_fill(frame):
    raw = nights(
        frame,
        [
            ("1", "2024-01-01", "f", "$10"),
            ("1", "2024-01-02", "f", None),
            ("1", "2024-01-03", "t", "$30"),
            ("2", "2024-01-01", "t", None),
            ("3", "bad", "t", "$5"),
            ("3", "2024-01-01", "x", "$5"),
        ],
    )
    out = {(r.listing_id, r.date.day): float(r.price) for r in clean.clean_calendar(raw).collect()}
    assert out == {(1, 1): 10.0, (1, 2): 20.0, (1, 3): 30.0, (2, 1): 0.0}


def test_calendar_price_sources(frame):
    raw = nights(frame, [("1", "2024-01-01", "f", "$10"), ("2", "2024-01-01", "f", "$20")])
    adjusted = clean.clean_calendar(raw.withColumnRenamed("price", "adjusted_price"))
    assert sorted(float(r.price) for r in adjusted.collect()) == [10.0, 20.0]
    prices = frame([(1, 55.0)], "id bigint, price double")
    own = clean.clean_calendar(raw.drop("price"), prices)
    assert sorted(float(r.price) for r in own.collect()) == [0.0, 55.0]


def test_reviews(frame):
    raw = frame(
        [("1", "2024-01-01", "a<br/>b"), ("1", "2024-01-02", "later"), ("2", "bad", "x")],
        "id string, date string, comments string",
    )
    rows = clean.clean_reviews(raw, ["date"]).collect()
    assert [(r.id, r.date, r.comments) for r in rows] == [(1, dt.date(2024, 1, 1), "a b")]


def test_metrics_and_unbooked_listing(frame):
    rows = [("1", f"2024-01-{d:02d}", "f" if d <= 4 else "t", "$125") for d in range(1, 11)]
    rows += [("2", "2024-02-01", "t", "$50"), ("3", "2024-02-01", "f", "$70")]
    monthly = features.monthly_sums(clean.clean_calendar(nights(frame, rows)))
    out = {r.id: r for r in features.listing_metrics(monthly).collect()}
    a, b, c = out[1], out[2], out[3]
    assert [float(x) for x in (a.occupancy_rate, a.adr, a.revpar)] == [0.4, 125.0, 50.0]
    assert [float(x) for x in (b.occupancy_rate, b.adr, b.revpar)] == [0.0, 0.0, 0.0]
    assert b.avg_open_listing_price == 50.0 and c.avg_open_listing_price is None


def test_price_category_edges(frame):
    df = frame([(i, float(i)) for i in range(1, 9)], "id int, price double")
    out = {r.id: r.price_category for r in features.price_categories(df).collect()}
    assert [out[i] for i in range(1, 9)] == (
        ["Budget"] * 2 + ["Mid-Range"] * 2 + ["Premium"] * 2 + ["Luxury"] * 2
    )
    same = frame([(i, 5.0) for i in range(4)], "id int, price double")
    assert {r.price_category for r in features.price_categories(same).collect()} == {"Budget"}


def test_bedrooms_count_at_least_one(frame):
    df = frame(
        [(1, "A", 100.0, 0.0), (2, "A", 200.0, None), (3, "A", 300.0, 2.0), (4, None, 9.0, 1.0)],
        "id int, neighbourhood_cleansed string, price double, bedrooms double",
    )
    out = {r.id: r for r in features.property_value(df).collect()}
    assert float(out[1].neighbourhood_median_price_per_bedroom) == 150.0
    assert float(out[3].estimated_property_value) == 75000.0
    assert out[4].estimated_property_value is None


def test_master_without_calendar_or_value(frame):
    schema = "id int, price double, estimated_property_value double"
    feats = frame([(1, 100.0, 0.0), (2, 100.0, None), (3, 100.0, 10.0)], schema)
    metrics = frame([(3, 40.0, 5.0)], "id int, adr double, revenue_estimate double")
    out = {r.id: r for r in features.master_table(feats, metrics).collect()}
    assert out[1].pricing_gap is None and out[1].pricing_signal == "Well-Priced"
    assert out[1].estimated_annual_roi_pct is None and out[2].estimated_annual_roi_pct is None
    assert float(out[3].estimated_annual_roi_pct) == 50.0
    assert out[3].pricing_signal == "Possibly Overpriced"


def test_experience_gap_takes_the_median(frame):
    df = frame([(1, dt.date(2001, 1, 1)), (2, None)], "id int, host_since date")
    out = {r.id: r.host_experience_years for r in features.host_experience(df, "2002-01-01").collect()}
    assert out == {1: 1.0, 2: 1.0}
    nobody = frame([(1, None)], "id int, host_since date")
    assert features.host_experience(nobody, "2002-01-01").first().host_experience_years == 0.0


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", ok', "line one\nline two"), ("2", None, "x")]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = files.read_raw_csv(spark, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_load_by_name_with_a_missing_column(spark, tmp_path):
    df = spark.createDataFrame([("A", "1"), ("", "2")], "neighbourhood_name string, neighbourhood_id string")
    tables.write_csv(df, str(tmp_path / "n"))
    rows = files.load_table(spark, str(tmp_path / "n"), "neighbourhoods").orderBy("neighbourhood_id")
    assert [tuple(r) for r in rows.collect()] == [(1, "A", None), (2, None, None)]


def test_empty_inputs_keep_the_schema(spark):
    raw = listings(spark, raw_listing()).limit(0)
    out = clean.clean_listings(raw, ["copy"])
    assert out.collect() == [] and "host_response_rate_missing" in out.columns
    full = features.property_value(features.listing_features(out, "2002-01-01"), out)
    assert full.collect() == []


def test_the_first_row_of_unsorted_files_wins(spark, tmp_path):
    """As a reader of one file after the other would keep it; splits are far smaller than the files."""
    import random

    rnd, expected, lines = random.Random(5), {}, []
    folder = tmp_path / "reviews"
    folder.mkdir()
    for part in range(3):
        rows = []
        for _ in range(400):
            key, text = rnd.randrange(300), f"text {rnd.random()}" + "x" * rnd.randrange(200)
            rows.append(f"{key},2024-01-{rnd.randrange(1, 29):02d},{text}")
            expected.setdefault(key, text)
        (folder / f"part-{part}.csv").write_text("\n".join(["id,date,comments", *rows, ""]))
        lines += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            raw = files.read_raw_csv(spark, str(folder), multiline=False, locate=True)
            assert size != "4096" or raw.rdd.getNumPartitions() > 8
            got = clean.clean_reviews(raw, ["_file_row"])
            assert got.columns == ["id", "date", "comments"]
            assert {r.id: r.comments for r in got.collect()} == expected and got.count() == len(expected)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_texts_are_joined_once(spark, tmp_path):
    raw = spark.createDataFrame([(i % 50, "2024-01-01", "t") for i in range(100)], "id int, date string, comments string")
    raw.write.parquet(str(tmp_path / "raw"))
    held = files.located(spark.read.parquet(str(tmp_path / "raw")))
    with_sizes = clean.clean_reviews(held, ["date"])
    plan = with_sizes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and with_sizes.count() == 50


def test_first_listing_and_host_follow_the_file(spark, tmp_path):
    from nightledger.plans.warehouse import Warehouse
    from nightledger.sources.binding import AS_OF

    (tmp_path / "l").mkdir()
    rows = ["7,9,$10.00,f,East", "3,9,$20.00,t,West", "7,8,$30.00,t,West", "5,8,,t,West", "5,8,$40.00,f,East", "5,8,$50.00,t,West"]
    (tmp_path / "l" / "l.csv").write_text("\n".join(["id,host_id,price,host_is_superhost,neighbourhood_cleansed", *rows, ""]))
    paths = {"listings": str(tmp_path / "l")}
    w = Warehouse.of_files(spark, paths, AS_OF, root=str(tmp_path / "out"))
    kept = {r.id: (r.host_id, float(r.price)) for r in w["listings_clean"].collect()}
    assert kept == {7: (9, 10.0), 3: (9, 20.0), 5: (8, 40.0)}
    from nightledger.operators import normalize

    flags = {r.host_id: r.is_superhost for r in normalize.hosts(w["listings_clean"]).collect()}
    assert flags == {9: 0, 8: 0}  # listing 7 comes before 3


def test_bad_cells_are_kept_with_their_place(spark, tmp_path):
    from nightledger.plans.warehouse import Warehouse
    from nightledger.sources.binding import AS_OF

    texts = {
        "listings": "id,host_id,price,host_since,host_is_superhost,beds\n1,x9,$5.00,soon,t,2\n2,7,free,2020-01-01,maybe,nan\n,,,,,\n",
        "calendar": "listing_id,date,available,price\n1,2024-13-01,t,$5\n1,2024-01-02,yes,\n1,2024-01-03,f,n/a\n",
        "reviews": "id,listing_id,date,comments\n1,1,2024-01-01,\"two\nlines\"\nx,1,later,ok\n",
    }
    paths = {}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(text)
        paths[name] = str(tmp_path / name)
    w = Warehouse.of_files(spark, paths, AS_OF, root=str(tmp_path / "out"))
    rows = w.rejected().collect()
    assert sorted((r.table_name, r.place, r.column, r.text) for r in rows) == [
        ("calendar", 0, "date", "2024-13-01"),
        ("calendar", 1, "available", "yes"),
        ("calendar", 2, "price", "n/a"),
        ("listings", 0, "host_id", "x9"),
        ("listings", 0, "host_since", "soon"),
        ("listings", 1, "host_is_superhost", "maybe"),
        ("listings", 1, "price", "free"),
        ("reviews", 1, "date", "later"),
        ("reviews", 1, "id", "x"),
    ]
    assert all(r.path.endswith("a.csv") and r.split == 0 for r in rows)
    # only that column is read back
    plan = w.rejected()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [_rejected") == 3
    counted = {(r.table_name, r.reason): r.rows_dropped for r in clean.dropped_rows(
        spark, {t: w._counts[f"raw_{t}"] for t in paths}, {"listings": 1, "reviews": 1}).collect()}
    assert counted["calendar", "unread date text"] == 1 and counted["reviews", "unread date text"] == 1


def test_bad_cells_of_load_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("listing_id,host_id,accommodates,first_review_date\n1,2,many,2024-01-01\n2,,3,never\n3,4,5,2024-01-01\n")
    loaded = files.load_table(spark, str(tmp_path / "l.csv"), "listings", trace=True)
    got = {r.listing_id: r["_rejected"] and [(c.column, c.text) for c in r["_rejected"].cells] for r in loaded.collect()}
    assert got == {1: [("accommodates", "many")], 2: [("first_review_date", "never")], 3: None}
    assert files.load_table(spark, str(tmp_path / "l.csv"), "listings").columns == loaded.columns[:-1]


def test_priced_nights_are_not_shuffled_to_find_gaps(frame, spark, monkeypatch):
    rows = [(i, "2001-01-01", "t", "5.00") for i in range(40)] + [(3, "2001-01-02", "t", None), (3, "2001-01-03", "f", "8.00")]
    rows += [(99, "2001-01-02", "t", None), (None, "2001-01-02", "t", None)]
    nights = frame(rows, "listing_id bigint, date string, available string, price string")
    nights = nights.withColumn("price", F.col("price").cast(clean.MONEY))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = {}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for most in (clean.BROADCAST_IDS, 0):
            monkeypatch.setattr(clean, "BROADCAST_IDS", most)
            filled = clean.fill_listing_median(nights)
            plan = filled._jdf.queryExecution().executedPlan().toString()
            semi = [line for line in plan.splitlines() if "LeftSemi" in line]
            priced = sorted((str(r.listing_id), r.date, float(r.price)) for r in filled.collect())
            found[most] = bool(semi) and all("BroadcastHashJoin" in line for line in semi), priced
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    (by_broadcast, rows), (by_shuffle, same) = found.values()
    assert by_broadcast and not by_shuffle and rows == same
    assert ("3", "2001-01-02", 6.5) in rows and ("99", "2001-01-02", 0.0) in rows and len(rows) == 44
