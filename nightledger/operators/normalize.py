"""Split of the master table into eight typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.functions.numeric import half_away, half_even
from nightledger.operators.features import VALUE_MULTIPLIER
from nightledger.operators.ranking import first_per_key, global_row_numbers
from nightledger.schemas import HOST_NAMES, LISTING_NAMES, ROW, SCORE_NAMES, TABLES


def _typed(df: DataFrame, table: str, also: list[str] | None = None) -> DataFrame:
    """Cast to the table's types; a value outside a type's range becomes NULL."""

    def cast(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("decimal") and dict(df.dtypes)[name] == "double":
            c = half_away(c, int(kind.rstrip(")").split(",")[1]))
        return c.try_cast(kind).alias(name)

    extra = [c for c in also or [] if c not in TABLES[table]]
    return df.select(*[cast(c, kind) for c, kind in TABLES[table].items() if c in df.columns], *extra)


def _project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist and leave the rest out."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items() if old in df.columns])


def _flag(c: Column, default: bool = False) -> Column:
    return F.coalesce(c, F.lit(default)).cast("int")


def _file_order(master: DataFrame) -> str:
    """The place in the raw file, where that is known, else the listing's id."""
    return ROW if ROW in master.columns else "id"


def neighbourhoods(master: DataFrame) -> DataFrame:
    """Distinct names in order with a dense key and the group of the first listing of the file
    (by id where the file's order isn't known); a missing name comes last (N01)."""
    group = "neighbourhood_group_cleansed"
    chosen = F.min_by(group, _file_order(master)) if group in master.columns else F.min(F.lit(None).cast("string"))
    names = master.groupBy(F.col("neighbourhood_cleansed").alias("neighbourhood_name")).agg(
        chosen.alias("neighbourhood_group")
    )
    name = F.col("neighbourhood_name")
    placed = global_row_numbers(
        names.withColumn("_order", F.struct(name.isNull().cast("int"), name)), "_order", "_order"
    )
    return placed.withColumn("neighbourhood_id", F.col("row_number")).transform(
        _typed, "neighbourhoods"
    )


def with_neighbourhood_id(master: DataFrame, dim: DataFrame) -> DataFrame:
    """A missing name matches the missing name."""
    keys = dim.select(
        F.col("neighbourhood_name").alias("_name"), F.col("neighbourhood_id").cast("bigint")
    )
    match = F.col("neighbourhood_cleansed").eqNullSafe(F.col("_name"))
    return master.join(keys, match, "left").drop("_name")


def hosts(master: DataFrame) -> DataFrame:
    """The host columns of each host's first listing of the file, or of its lowest listing id
    where the file's order isn't known (N03)."""
    narrow = _project(master, {**HOST_NAMES, _file_order(master): "_listing"})
    first = first_per_key(narrow, ["host_id"], [F.col("_listing").asc()])
    flags = {c: _flag(F.col(c)) for c in ("is_superhost", "identity_verified") if c in first.columns}
    return _typed(first.withColumns(flags), "hosts")


def listings(master: DataFrame, dim: DataFrame) -> DataFrame:
    """N04."""
    df = _project(with_neighbourhood_id(master, dim), LISTING_NAMES)
    flags = {c: _flag(F.col(c)) for c in ("instant_bookable", "is_stale_listing") if c in df.columns}
    return _typed(df.withColumns(flags), "listings")


def listing_performance(master: DataFrame) -> DataFrame:
    """Only listings that have calendar rows."""
    df = master.withColumnRenamed("id", "listing_id").dropna(subset=["total_nights_tracked"])
    return _typed(df, "listing_performance")


def listing_valuation(master: DataFrame) -> DataFrame:
    """N06."""
    df = master.withColumnRenamed("id", "listing_id").withColumns(
        {
            "is_synthetic_valuation": _flag(F.col("is_synthetic_valuation"), True),
            "valuation_multiplier": F.lit(VALUE_MULTIPLIER),
        }
    )
    return _typed(df, "listing_valuation")


def calendar_daily(calendar: DataFrame) -> DataFrame:
    """N07."""
    df = calendar.select(
        "listing_id",
        F.col("date").alias("calendar_date"),
        F.col("available").cast("int").alias("is_available"),
        "price",
    )
    return _typed(df, "calendar_daily")


def reviews(clean: DataFrame, also: list[str] | None = None) -> DataFrame:
    """N08; ``also`` names extra columns to carry along."""
    renamed = clean.withColumnsRenamed({"id": "review_id", "date": "review_date"})
    return _typed(renamed, "reviews", also)


def review_scores(master: DataFrame, rating_scale: float = 20) -> DataFrame:
    """Scores on a 0-5 scale; ``rating_scale`` divides the overall rating."""
    df = _project(master, SCORE_NAMES)
    if "rating" in df.columns:
        df = df.withColumn("rating", half_even(F.col("rating") / F.lit(float(rating_scale))))
    return _typed(df, "review_scores")
