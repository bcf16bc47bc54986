"""Cleaning of the three raw files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.functions.numeric import clip, upper_clip
from nightledger.functions.parsing import first_number, parse_as, parse_price, rejected, strip_breaks
from nightledger.operators.quantiles import column_quantiles, exact_quantiles
from nightledger.operators.ranking import first_per_key_placed, first_per_key_wide
from nightledger.operators.scalars import with_values
from nightledger.schemas import CALENDAR_REQUIRED, LISTING_COLUMNS, MEDIAN_FILLED, MONEY, REJECTED, ROW


def keep_present(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Wanted columns that exist, and the ones that do not (S02); looks at the schema only."""
    missing = sorted(set(wanted) - set(df.columns))
    return df.select(*[c for c in wanted if c in df.columns]), missing


def require_columns(df: DataFrame, required: list[str], table: str) -> DataFrame:
    """S03."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{table} is missing required columns: {missing}")
    return df


def _row_order(df: DataFrame, order: list[str] | None) -> list[Column]:
    """The stated file order, else every column, so that the choice is repeatable."""
    return [F.col(c).asc() for c in (order or df.columns)]


#: Ids of listings that are broadcast at most, about 16 MB.
BROADCAST_IDS = 1_000_000

# How the other raw columns are read.
CALENDAR_TYPES = {"listing_id": "bigint", "date": "date", "available": "flag", "price": "price", "adjusted_price": "price"}
REVIEW_TYPES = {"id": "bigint", "listing_id": "bigint", "reviewer_id": "bigint", "date": "date"}
RAW_TYPES = {"listings": LISTING_COLUMNS, "calendar": CALENDAR_TYPES, "reviews": REVIEW_TYPES}


def with_rejected(raw: DataFrame, name: str) -> DataFrame:
    """Raw rows with their cells that typing turns into NULL, in the pass that writes them.

    The column is NULL in rows without such a cell, so that reading it alone is cheap. The
    place of a night goes there too and is not kept for the others.
    """
    types = {c: k for c, k in RAW_TYPES[name].items() if c in raw.columns and k != "string"}
    cells = []
    for c, kind in types.items():
        text = rejected(F.col(c), parse_as(F.col(c), kind))
        cells.append(F.when(text.isNotNull(), F.struct(F.lit(c).alias("column"), text.alias("text"))))
    listed = F.array_compact(F.array(*cells)) if cells else F.array()
    place = F.col(ROW) if ROW in raw.columns else F.lit(None).cast("struct<path:string,split:bigint,place:bigint>")
    marked = raw.withColumn(REJECTED, listed).withColumn(
        REJECTED, F.when(F.size(REJECTED) > 0, F.struct(place.alias("row"), F.col(REJECTED).alias("cells")))
    )
    return marked.drop(ROW) if name == "calendar" else marked


def rejected_cells(raw: DataFrame, name: str) -> DataFrame:
    """(table_name, path, split, place, column, text): a row per rejected cell."""
    found = raw.where(F.col(REJECTED).isNotNull()).select(
        F.col(f"{REJECTED}.row").alias("r"), F.explode(f"{REJECTED}.cells").alias("c")
    )
    return found.select(F.lit(name).alias("table_name"), "r.path", "r.split", "r.place", "c.column", "c.text")


def type_listings(df: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Known columns parsed to their types; ``also`` names extra columns to carry along."""
    kept, _ = keep_present(df, list(LISTING_COLUMNS))
    columns = {
        c: parse_as(F.col(c), kind) for c, kind in LISTING_COLUMNS.items() if c in kept.columns
    }
    columns["price"] = columns["price"].cast(MONEY)
    if "bathrooms" not in columns and "bathrooms_text" in columns:
        columns["bathrooms"] = first_number(F.col("bathrooms_text"))
    return df.select(
        *[c.alias(name) for name, c in columns.items()], *[F.col(c) for c in also or []]
    )


def market_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the median of every listed column that exists."""
    present = [c for c in columns if c in df.columns]
    return column_quantiles(df, {f"_median_{c}": (c, 0.5) for c in present})


def fill_medians(df: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Fill gaps with the column's median over all rows of ``source``."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    medians = market_medians(df if source is None else source, present)
    filled = {c: F.coalesce(F.col(c), F.col(f"_median_{c}")) for c in present}
    return with_values(df, medians).withColumns(filled).drop(*medians.columns)


def flag_and_fill(df: DataFrame, column: str, value: float = 0.0) -> DataFrame:
    """Record which rows lacked a value, then fill it."""
    if column not in df.columns:
        return df
    return df.withColumns(
        {
            f"{column}_missing": F.col(column).isNull(),
            column: F.coalesce(F.col(column), F.lit(value)),
        }
    )


def fill_false(df: DataFrame, column: str) -> DataFrame:
    """C08."""
    if column not in df.columns:
        return df
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(False)))


def iqr_bounds(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row: low = max(Q1 - k IQR, 0), high = Q3 + k IQR (C11)."""
    q = column_quantiles(df, {"q1": (column, 0.25), "q3": (column, 0.75)})
    q1, q3 = F.col("q1").cast(MONEY), F.col("q3").cast(MONEY)
    spread = (q3 - q1) * F.lit(k).cast("decimal(4,2)")
    zero = F.lit(0).cast(MONEY)
    low = (q1 - spread).cast(MONEY)
    return q.select(
        F.when(low < zero, zero).otherwise(low).alias("low"), (q3 + spread).cast(MONEY).alias("high")
    )


def cap_iqr(df: DataFrame, column: str, k: float = 1.5, source: DataFrame | None = None):
    """Clip to the IQR bounds of ``source``, keeping every row (C11)."""
    bounds = iqr_bounds(df if source is None else source, column, k).select(
        F.col("low").alias("_low"), F.col("high").alias("_high")
    )
    capped = clip(F.col(column), F.col("_low"), F.col("_high")).cast(MONEY)
    return with_values(df, bounds).withColumn(column, capped).drop("_low", "_high")


def surviving_listings(typed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Priced listings, one row per id."""
    return first_per_key_wide(typed.dropna(subset=["price"]), ["id"], _row_order(typed, order))


def clean_listings(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Raw listings -> typed, filled, deduplicated and capped listings (C17)."""
    extra = [c for c in order or [] if c not in LISTING_COLUMNS]
    return clean_typed_listings(type_listings(raw, also=extra), order)


def clean_typed_listings(typed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rest of C17 after parsing; give it a written frame, as it is read several times.

    The medians come from all typed rows, the price bounds from the surviving ones, so
    both are read from the narrow frames they need rather than from each other's output.
    """
    # a listing's place in the file also says which is the first of its host
    extra = [c for c in order or [] if c not in LISTING_COLUMNS and c != ROW]
    kept = surviving_listings(typed, order)
    df = (
        kept.drop(*extra)
        .transform(fill_medians, MEDIAN_FILLED, typed)
        .transform(flag_and_fill, "host_response_rate")
        .transform(fill_false, "host_is_superhost")
        .transform(cap_iqr, "price", 1.5, kept.select("price"))
    )
    if "minimum_nights" in df.columns:
        df = df.withColumn("minimum_nights", upper_clip(F.col("minimum_nights"), 365))
    return df


def calendar_price(cal: DataFrame, listing_prices: DataFrame | None = None) -> DataFrame:
    """Night price from ``price``, else ``adjusted_price``, else the listing's own."""
    if "price" in cal.columns:
        cal = cal.withColumn("price", parse_price(F.col("price")).cast(MONEY))
    elif "adjusted_price" in cal.columns:
        cal = cal.withColumn("price", parse_price(F.col("adjusted_price")).cast(MONEY))
    elif listing_prices is not None:
        base = listing_prices.select(
            F.col("id").alias("_id"), F.col("price").cast(MONEY).alias("price")
        )
        cal = cal.join(base, F.col("listing_id") == F.col("_id"), "left").drop("_id")
    else:
        raise ValueError("calendar has neither price nor adjusted_price, and no listing prices")
    if "adjusted_price" in cal.columns:
        cal = cal.withColumn("adjusted_price", parse_price(F.col("adjusted_price")).cast(MONEY))
    return cal


def fill_listing_median(cal: DataFrame) -> DataFrame:
    """Missing night prices take the listing's own median, then 0 (C14).

    Only the unpriced nights are joined with medians; priced nights, the bulk, are passed on
    as they are. Medians are computed only for listings that have a gap. These are counted
    first and broadcast up to ``BROADCAST_IDS``; Spark's own estimate comes from the size of
    all nights, and it would shuffle (listing, price) of every priced night before it knew better.
    """
    return priced_nights(cal).unionByName(closed_gaps(cal))


def priced_nights(cal: DataFrame) -> DataFrame:
    return cal.where(F.col("price").isNotNull())


def closed_gaps(cal: DataFrame) -> DataFrame:
    """Only the nights of ``fill_listing_median`` that had no price."""
    priced = priced_nights(cal)
    gaps = cal.where(F.col("price").isNull())
    gappy = gaps.select("listing_id").distinct()
    if gappy.count() <= BROADCAST_IDS:
        gappy = F.broadcast(gappy)
    medians = exact_quantiles(
        priced.join(gappy, "listing_id", "left_semi"), "price", {"_median": 0.5}, by=["listing_id"]
    )
    filled = F.coalesce(F.col("_median").cast(MONEY), F.lit(0).cast(MONEY))
    return gaps.join(medians, "listing_id", "left").withColumn("price", filled).drop("_median")


def type_calendar(raw: DataFrame, listing_prices: DataFrame | None = None) -> DataFrame:
    require_columns(raw, CALENDAR_REQUIRED, "calendar")
    typed = raw.withColumns(
        {
            "listing_id": F.col("listing_id").try_cast("bigint"),
            "date": parse_as(F.col("date"), "date"),
            "available": parse_as(F.col("available"), "flag"),
        }
    )
    priced = calendar_price(typed, listing_prices)
    extra = ["adjusted_price"] if "adjusted_price" in priced.columns else []
    return priced.select(*CALENDAR_REQUIRED, "price", *extra)


def clean_calendar(raw: DataFrame, listing_prices: DataFrame | None = None) -> DataFrame:
    """Raw calendar -> typed nights with a price and a known state."""
    return clean_typed_calendar(type_calendar(raw, listing_prices))


def clean_typed_calendar(typed: DataFrame) -> DataFrame:
    """The rest of C18 after parsing; give it a written frame, as it is read several times."""
    return fill_listing_median(typed).dropna(subset=["date", "available"])


def clean_reviews(raw: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Raw reviews -> dated, de-marked-up, deduplicated reviews."""
    columns = {"date": parse_as(F.col("date"), "date")}
    for c in ("id", "listing_id", "reviewer_id"):
        if c in raw.columns:
            columns[c] = F.col(c).try_cast("bigint")
    if "comments" in raw.columns:
        columns["comments"] = strip_breaks(F.col("comments"))
    df = raw.drop(REJECTED).withColumns(columns).dropna(subset=["date"])
    if "id" not in df.columns:
        return df.drop(ROW)
    if ROW in df.columns:
        places = [*[c for c in order or [] if c != ROW], ROW]
        return first_per_key_placed(df, ["id"], places).drop(ROW)
    return first_per_key_wide(df, ["id"], _row_order(df, order))


def dropped_counts(raw_name: str, df: DataFrame) -> dict[str, Column]:
    """What C16 needs of a raw table, to be counted in the pass that writes it."""
    rows = {"rows": F.count(F.lit(1))}
    if raw_name == "listings":
        price = parse_as(F.col("price"), "price").cast(MONEY)
        return rows | {"no price": F.count_if(price.isNull())}
    date = parse_as(F.col("date"), "date")
    unread = F.count_if(F.col("date").isNotNull() & date.isNull())
    if raw_name == "reviews":
        return rows | {"no date": F.count_if(date.isNull()), "unread date text": unread}
    gap = date.isNull() | parse_as(F.col("available"), "flag").isNull()
    return rows | {"no date or state": F.count_if(gap), "unread date text": unread}


def dropped_rows(spark: SparkSession, raw: dict[str, dict[str, int]], kept: dict[str, int]) -> DataFrame:
    """Rows each cleaning step removes, one row per step.

    ``raw`` has the counts of the three raw tables, ``kept`` the sizes of the clean listings
    and reviews, whose ids are distinct.
    """

    def repeats(table: str, reason: str) -> tuple:
        before = raw[table]["rows"] - raw[table][reason]
        return (table, "duplicate id", before, before - kept[table])

    steps = [(t, reason, c["rows"], n) for t, c in raw.items() for reason, n in c.items() if reason != "rows"]
    steps += [repeats("listings", "no price"), repeats("reviews", "no date")]
    schema = "table_name string, reason string, rows_before bigint, rows_dropped bigint"
    return spark.createDataFrame(steps, schema)
