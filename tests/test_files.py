"""The whole way from raw CSV files to load files and the report."""

import pytest
from pyspark.sql import functions as F

from nightledger.__main__ import run
from nightledger.sources import files, tables
from nightledger.sources.binding import AS_OF


@pytest.fixture(scope="module")
def raw_files(w, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    paths = {name: str(folder / name) for name in ("listings", "calendar", "reviews")}
    # the first copy of each listing is the only one the tables keep
    tables.write_csv(w["raw_listings"].where("copy = 1").drop("copy", "_rejected"), paths["listings"])
    tables.write_csv(w["raw_calendar"].drop("_rejected"), paths["calendar"])
    tables.write_csv(w["raw_reviews"].drop("_rejected"), paths["reviews"])
    return paths


def test_files_give_the_same_tables(spark, w, raw_files, tmp_path):
    done = run(spark, raw_files, str(tmp_path), AS_OF, model=False)
    same = ["hosts", "listing_performance", "calendar_daily", "neighbourhoods"]
    for name in same:
        ours, theirs = done[name], w[name].select(done[name].columns)
        assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0
    loaded = files.load_tables(spark, str(tmp_path / "load"))
    for name in [*same, "reviews", "review_scores"]:
        assert loaded[name].exceptAll(done[name]).count() == 0
        assert loaded[name].count() == done[name].count()
    report = spark.read.text(str(tmp_path / "report")).collect()
    assert report[0].value.startswith("# ") and len(report) == 58
    pack = files.read_raw_csv(spark, str(tmp_path / "business_insights"))
    assert pack.count() == 7
    bad = files.read_raw_csv(spark, str(tmp_path / "rejected"))
    assert {(r.table_name, r.column, r.text) for r in bad.collect()} == {("listings", "host_response_rate", "N/A")}


def test_a_broken_rule_stops_the_load(spark, raw_files, tmp_path):
    out = tmp_path / "gated"
    with pytest.raises(ValueError, match="quality gate failed: calendar_daily: listing_id in listings"):
        run(spark, raw_files, str(out), AS_OF, allowed=set())
    assert not (out / "load").exists() and not (out / "report").exists()


def test_closing_removes_what_was_written(spark, tmp_path):
    from nightledger.plans import stages
    from nightledger.plans.warehouse import Warehouse
    from nightledger.sources import binding
    from tests.conftest import SF_DIR

    root = tmp_path / "own"
    order = {"listings": ["copy"], "reviews": ["date"]}
    raw = lambda name: binding.RAW[name](spark, SF_DIR)
    own = Warehouse(spark, raw, AS_OF, order, root=str(root))
    assert stages.s01_read_csv(own).count() > 0 and stages.x01_incremental_load(own).count() > 0
    assert not [p for p in root.iterdir() if "arriving" in p.name]
    assert len(list(root.iterdir())) >= 4
    own.close()
    assert not root.exists()


def test_calendar_without_prices_uses_the_listing(spark, raw_files, tmp_path):
    bare = str(tmp_path / "bare")
    cal = files.read_raw_csv(spark, raw_files["calendar"], multiline=False)
    tables.write_csv(cal.drop("price"), bare)
    done = run(spark, {**raw_files, "calendar": bare}, str(tmp_path / "out"), AS_OF, model=False)
    joined = done["calendar_clean"].join(
        done["listings_clean"].select(F.col("id").alias("listing_id"), F.col("price").alias("own")),
        "listing_id",
    )
    assert joined.count() > 0 and joined.where("price <> own").count() == 0
