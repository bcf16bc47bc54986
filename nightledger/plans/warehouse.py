"""Stage tables: each is built on first use, written as Parquet and read back.

Writing a stage cuts the lineage, so a lost executor costs one stage at most, and every
later question reads columns of a written table instead of the raw files.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators import audit, clean, features, normalize, star
from nightledger.operators.ranking import held
from nightledger.functions.parsing import strip_breaks
from nightledger.schemas import LISTING_COLUMNS, ROW, TABLES, TEXT, with_provenance
from nightledger.session import shared_dir
from nightledger.sources import binding
from nightledger.sources.files import located, read_raw_csv
from nightledger.sources.tables import read_stage, remove, write_stage

STAR = {
    "DimDate": "dim_date",
    "DimNeighbourhood": "dim_neighbourhood",
    "DimHost": "dim_host",
    "DimListing": "dim_listing",
    "FactListingPerformance": "fact_performance",
    "FactCalendarDaily": "fact_calendar",
    "FactCalendarMonthly": "fact_calendar_monthly",
    "FactReviews": "fact_reviews",
    "FactReviewScores": "fact_review_scores",
}


class Warehouse:
    """``raw`` gives the raw listings, calendar and reviews by name; ``order`` names the
    columns that state the file order of listings and reviews, where there are any.

    Raw reviews have ``comments``, or the number (TEXT) of a text in ``raw("texts")``. Such
    texts are joined when they are read and never written with the reviews, which may quote
    each of them any number of times."""

    def __init__(
        self,
        spark: SparkSession,
        raw: Callable[[str], DataFrame],
        as_of: str,
        order: dict[str, list[str]] | None = None,
        root: str | None = None,
    ):
        self.spark, self.raw, self.as_of, self.order = spark, raw, as_of, order or {}
        self.root = root or os.path.join(shared_dir(spark), f"nightledger-{uuid.uuid4().hex}")
        self._stages: dict[str, DataFrame] = {}
        self.models: set[str] = set()
        # what the writes of the stages counted: by table, or by raw file
        self._counts: dict[str, dict[str, int]] = {}

    # Stages that are written, and the column a stage is partitioned by.
    PARTITIONED = {"fact_calendar": "YearMonth"}
    # Of these, stages that are rebalanced by that column while they have few columns.
    REBALANCED = {"fact_calendar"}
    # Plain projections of a written stage.
    UNWRITTEN = {
        "calendar_clean",
        "calendar_daily",
        "monthly_agg",
        "raw_reviews",
        "reviews_clean",
        "reviews",
        "review_keys",
        "dim_neighbourhood",
        "dim_host",
        "dim_listing",
    }

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._stages:
            df = getattr(self, f"_{name}")()
            if name not in self.UNWRITTEN:
                path = os.path.join(self.root, name)
                table, counts = self._watched(name, df)
                seen = write_stage(df, path, self.PARTITIONED.get(name), counts, name in self.REBALANCED)
                if seen:
                    self._counts[table] = seen
                df = read_stage(self.spark, path, df.schema)
            self._stages[name] = df
        return self._stages[name]

    def tables(self) -> dict[str, DataFrame]:
        """The eight normalised tables."""
        self["review_rows"]  # first, as raw listings count them
        return {t: self[t] for t in TABLES}

    def audited(self) -> dict[str, DataFrame]:
        """The eight tables for audits, which don't look at the texts of reviews."""
        self["review_rows"]  # first, as in ``tables``
        return {t: self["review_keys" if t == "reviews" else t] for t in TABLES}

    def quoted(self, reviews: DataFrame, short: bool = False, **columns: Column) -> DataFrame:
        """Reviews with columns made of ``comments``, once for each text where they share texts;
        ``short`` says that the columns may be broadcast."""
        if TEXT not in reviews.columns:
            return reviews.withColumns(columns)
        texts = self["texts"].select(TEXT, *[c.alias(name) for name, c in columns.items()])
        return reviews.join(held(texts) if short else texts, TEXT, "left").drop(TEXT)

    def _watched(self, name: str, df: DataFrame):
        if name.startswith("raw_") or name == "review_rows":
            raw = "reviews" if name == "review_rows" else name.removeprefix("raw_")
            needed = {"listings": {"price"}, "calendar": {"date", "available"}, "reviews": {"date"}}
            fits = needed[raw] <= set(df.columns)
            return f"raw_{raw}", clean.dropped_counts(raw, df) if fits else {}
        if name == "listings_clean":
            return name, {"rows": F.count(F.lit(1))}
        return audit.watched(name)

    def counts(self) -> dict[str, dict[str, int]]:
        """What was counted while the eight tables were written."""
        self.tables()
        if "calendar_daily" not in self._counts:
            # the nights are no table of their own: one pass over them, without a shuffle
            table, counts = audit.watched("calendar_clean")
            seen = self["calendar_clean"].agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
            self._counts[table] = dict(zip(counts, seen.first()))
        return {t: self._counts[t] for t in TABLES}

    def dropped_rows(self) -> DataFrame:
        """C16, from the writes of the raw and the clean files."""
        kept = {"listings": "listings_clean", "reviews": "reviews_clean"}
        for name in ("raw_listings", "raw_calendar", "raw_reviews", *kept.values()):
            self[name]
        raw = {t: self._counts[f"raw_{t}"] for t in ("listings", "calendar", "reviews")}
        sizes = {"listings": self._counts["listings_clean"], "reviews": self._counts["reviews"]}
        return clean.dropped_rows(self.spark, raw, {t: c["rows"] for t, c in sizes.items()})

    def rejected(self) -> DataFrame:
        """Every cell of the raw files that typing turned into NULL, with its place."""
        names = ("listings", "calendar", "reviews")
        parts = [clean.rejected_cells(self[f"raw_{name}"], name) for name in names]
        return reduce(DataFrame.unionByName, parts)

    def star(self) -> "Star":
        return Star(self)

    def close(self) -> None:
        """Remove everything that was written under this warehouse's own folder."""
        remove(self.spark, self.root)
        self._stages.clear()
        self.models.clear()
        self._counts.clear()
        for key in [k for k, w in _open.items() if w is self]:
            del _open[key]

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str) -> Warehouse:
        """Over the given star-schema tables, shaped into raw files first."""
        order = {"listings": ["copy"], "reviews": ["date"]}

        def raw(name: str) -> DataFrame:
            more = [w["texts"]] if name == "reviews" else []
            if name == "listings" and "review_rows" in w._stages:
                more = [w["review_rows"]]
            return binding.RAW[name](spark, sf_dir, *more)

        w = cls(spark, raw, binding.AS_OF, order)
        return w

    @classmethod
    def of_files(
        cls, spark: SparkSession, paths: dict[str, str], as_of: str, root: str | None = None
    ) -> Warehouse:
        """Over raw CSV files: listings, calendar, reviews; of repeated ids the file's first row stays."""

        def read(name: str) -> DataFrame:
            return read_raw_csv(spark, paths[name], multiline=name != "calendar", locate=True)

        return cls(spark, read, as_of, {"listings": [ROW], "reviews": [ROW]}, root)

    def _raw_listings(self) -> DataFrame:
        return clean.with_rejected(self.raw("listings"), "listings")

    def _raw_calendar(self) -> DataFrame:
        return clean.with_rejected(self.raw("calendar"), "calendar")

    def _texts(self) -> DataFrame:
        return self.raw("texts")

    def _review_rows(self) -> DataFrame:
        return clean.with_rejected(self.raw("reviews"), "reviews")

    def _raw_reviews(self) -> DataFrame:
        rows = self["review_rows"]
        return self.quoted(rows, comments=F.col("comments")) if TEXT in rows.columns else rows

    def _listings_typed(self) -> DataFrame:
        extra = [c for c in self.order.get("listings", []) if c not in LISTING_COLUMNS]
        return clean.type_listings(self["raw_listings"], also=extra)

    def _listings_clean(self) -> DataFrame:
        return clean.clean_typed_listings(self["listings_typed"], self.order.get("listings"))

    def _calendar_typed(self) -> DataFrame:
        # raw nights are a stage only for those who ask for them
        raw, own = self["raw_calendar"] if "raw_calendar" in self._stages else self.raw("calendar"), None
        if not {"price", "adjusted_price"} & set(raw.columns):
            own = self["listings_clean"].select("id", "price")
        return clean.type_calendar(raw, own).drop("adjusted_price")

    def _calendar_clean(self) -> DataFrame:
        nights = clean.priced_nights(self["calendar_typed"]).unionByName(self["calendar_gaps"])
        known = nights.dropna(subset=["date", "available"])
        return known.withColumn("year_month", F.date_format("date", "yyyy-MM"))

    def _calendar_gaps(self) -> DataFrame:
        return clean.closed_gaps(self["calendar_typed"])

    def _reviews_kept(self) -> DataFrame:
        raw = self["review_rows"]
        # without a place in the files, the place in the written stage breaks ties
        placed = raw if ROW in raw.columns else located(raw)
        return clean.clean_reviews(placed, self.order.get("reviews"))

    def _reviews_clean(self) -> DataFrame:
        kept = self["reviews_kept"]
        return self.quoted(kept, comments=strip_breaks(F.col("comments"))) if TEXT in kept.columns else kept

    def _monthly(self) -> DataFrame:
        sums = features.monthly_sums(self["calendar_clean"])
        # metrics come from the nights; no other stage reads the rest
        return sums.drop("open_price_sum", "open_nights", "first_night", "last_night")

    def _monthly_agg(self) -> DataFrame:
        return features.monthly_aggregate(self["monthly"])

    def _metrics(self) -> DataFrame:
        return features.night_metrics(self["calendar_clean"])

    def _master(self) -> DataFrame:
        listings = self["listings_clean"]
        featured = features.listing_features(listings, self.as_of)
        valued = features.property_value(featured, listings)
        return with_provenance(features.master_table(valued, self["metrics"]))

    def _neighbourhoods(self) -> DataFrame:
        return normalize.neighbourhoods(self["master"])

    def _hosts(self) -> DataFrame:
        return normalize.hosts(self["master"])

    def _listings(self) -> DataFrame:
        return normalize.listings(self["master"], self["neighbourhoods"])

    def _listing_performance(self) -> DataFrame:
        return normalize.listing_performance(self["master"])

    def _listing_valuation(self) -> DataFrame:
        return normalize.listing_valuation(self["master"])

    def _calendar_daily(self) -> DataFrame:
        return normalize.calendar_daily(self["calendar_clean"])

    def _reviews(self) -> DataFrame:
        return normalize.reviews(self["reviews_clean"])

    def _review_keys(self) -> DataFrame:
        return normalize.reviews(self["reviews_kept"].drop("comments"))

    def _review_scores(self) -> DataFrame:
        return normalize.review_scores(self["master"])

    def _listing_facts(self) -> DataFrame:
        """Listings with performance, valuation and score columns, joined once for all
        questions at listing grain."""
        perf = self["listing_performance"].withColumn("has_performance", F.lit(True))
        value = self["listing_valuation"].withColumn("has_valuation", F.lit(True))
        score = self["review_scores"].select("listing_id", "composite_score")
        facts = self["listings"]
        for side in (perf, value, score):
            facts = facts.join(side, "listing_id", "left")
        return facts

    def _dim_date(self) -> DataFrame:
        return star.dim_date(
            self["metrics"].agg(
                F.min("calendar_start").alias("first_night"), F.max("calendar_end").alias("last_night")
            )
        )

    def _dim_neighbourhood(self) -> DataFrame:
        return star.dim_neighbourhood(self["neighbourhoods"])

    def _dim_host(self) -> DataFrame:
        return star.dim_host(self["hosts"])

    def _dim_listing(self) -> DataFrame:
        return star.dim_listing(self["listings"])

    def _fact_performance(self) -> DataFrame:
        return star.fact_performance(
            self["listing_performance"], self["listing_valuation"], self["listings"]
        )

    def _fact_calendar(self) -> DataFrame:
        return star.fact_calendar(self["calendar_daily"], self["listings"])

    def _fact_calendar_monthly(self) -> DataFrame:
        return star.fact_calendar_monthly(self["monthly"], self["listings"])

    def _fact_reviews(self) -> DataFrame:
        return star.fact_reviews(self["review_keys"], self["listings"])

    def _fact_review_scores(self) -> DataFrame:
        return star.fact_review_scores(self["review_scores"], self["listings"])


class Star:
    """The star tables by their model names; each is built when first asked for."""

    def __init__(self, warehouse: Warehouse):
        self._warehouse = warehouse

    def __getitem__(self, name: str) -> DataFrame:
        return self._warehouse[STAR[name]]


_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse of this application and input folder."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _open:
        _open[key] = Warehouse.of_tables(spark, sf_dir)
    return _open[key]


Query = Callable[[Warehouse], DataFrame]
