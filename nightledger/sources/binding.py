"""Shapes the given star-schema tables into raw rental files (all columns text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators.features import dealt_by
from nightledger.operators.ranking import held
from nightledger.schemas import TEXT

# Labels and the day all ages are counted to.
AS_OF = "2002-01-01"
ROOM_TYPES = ["Entire home/apt", "Private room", "Shared room", "Hotel room"]
RESPONSE_TIMES = ["within an hour", "within a few hours", "within a day"]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(labels: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in labels]), (index + 1).cast("int"))


def _base_price() -> F.Column:
    cents = F.floor(F.col("p_retailprice") * (F.lit(10) + F.col("p_size")) + 0.5)
    return (cents / 100).cast("decimal(10,2)")


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, comments, TEXT): the texts that reviews quote, numbered by row.

    Give the result a written form before rows are joined with it: the numbers are fixed then.
    """
    return given(spark, sf_dir, "documents").select(
        "doc_id",
        F.replace("text", F.lit("\n"), F.lit("<br/>")).alias("comments"),
        F.monotonically_increasing_id().alias(TEXT),
    )


def raw_reviews(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """Reviews with the number of their text in ``texts`` (by default, of the given documents);
    a text is quoted many times, so it isn't copied to each."""
    lines = given(spark, sf_dir, "lineitem")
    first_line = lines.groupBy("l_orderkey").agg(
        F.min(F.struct("l_shipdate", "l_partkey")).alias("m")
    )
    documents = (raw_texts(spark, sf_dir) if texts is None else texts).select("doc_id", TEXT)
    size = documents.agg(F.count(F.lit(1)).alias("n_docs"))
    orders = (
        given(spark, sf_dir, "orders")
        .join(first_line, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(given(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("wanted_doc", F.col("o_orderkey") % size.scalar())
    )
    return orders.join(held(documents), F.col("wanted_doc") == F.col("doc_id"), "left").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("m.l_partkey").cast("string").alias("listing_id"),
        F.col("o_custkey").cast("string").alias("reviewer_id"),
        F.col("c_name").alias("reviewer_name"),
        F.col("o_orderdate").cast("date").cast("string").alias("date"),
        TEXT,
    )


def raw_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights in the order of exports, where a listing's nights lie together: lines are dealt by
    listing alone, which also serves the join with parts."""
    part = given(spark, sf_dir, "part").select("p_partkey", _base_price().alias("bp"))
    lines = given(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.col("l_shipdate").cast("date").alias("night"),
        "l_linenumber",
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_tax") - F.col("l_discount")).alias("swing"),
    )
    # The largest swing gives the largest price of the night, so the price is computed
    # once per night after the grouping.
    nights = dealt_by(lines, "l_partkey").groupBy("l_partkey", "night").agg(
        F.max(F.col("returned").cast("int")).alias("booked"),
        F.sum("l_linenumber").alias("lines"),
        F.max("swing").alias("swing"),
    )
    listing, total = F.col("l_partkey"), F.col("lines")
    factor = F.lit(1) + F.lit(4) * F.col("swing")
    price = (F.floor(F.col("bp").cast("double") * factor * 100 + 0.5) / 100).cast("decimal(10,2)")
    no_price = ((listing % 41 == 0) & (total % 2 == 0)) | (listing % 401 == 1)
    flag = F.when((listing + total) % 211 == 0, None).when(F.col("booked") == 1, "f").otherwise("t")
    return nights.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        listing.cast("string").alias("listing_id"),
        F.col("night").cast("string").alias("date"),
        flag.alias("available"),
        F.when(~no_price, F.concat(F.lit("$"), price.cast("string"))).alias("price"),
    )


def raw_listings(spark: SparkSession, sf_dir: str, reviews: DataFrame | None = None) -> DataFrame:
    """Listings as exported, plus ``copy``, the place of a row among its duplicates.

    ``reviews`` are the raw reviews where these have been written already.
    """
    fields = [
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    ]
    first_line = (
        given(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.min(F.struct(*fields)).alias("m"))
        .select(
            "l_partkey",
            F.col("m.l_suppkey").alias("sk"),
            F.col("m.l_discount").alias("disc"),
            F.col("m.l_tax").alias("tax"),
            F.col("m.l_linenumber").alias("ln"),
            F.col("m.l_quantity").alias("q"),
        )
    )
    per_host = first_line.join(
        given(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    host_counts = per_host.groupBy(F.col("sk").alias("counted_host")).agg(
        F.count(F.lit(1)).alias("host_listings")
    )
    reviews = (
        (raw_reviews(spark, sf_dir) if reviews is None else reviews)
        .select("listing_id", F.col("date").cast("date").alias("d"))
        .groupBy(F.col("listing_id").cast("bigint").alias("reviewed"))
        .agg(
            F.count(F.lit(1)).alias("n_reviews"),
            F.sum((F.col("d") >= F.lit("2001-01-01").cast("date")).cast("int")).alias("n_recent"),
            F.min("d").alias("d_first"),
            F.max("d").alias("d_last"),
        )
    )
    base = (
        per_host.join(given(spark, sf_dir, "supplier"), F.col("sk") == F.col("s_suppkey"))
        .join(given(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(given(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(host_counts, F.col("sk") == F.col("counted_host"))
        .join(reviews, F.col("p_partkey") == F.col("reviewed"), "left")
    )
    pk, size, host = F.col("p_partkey"), F.col("p_size"), F.col("s_suppkey")
    bp = _base_price()
    asked = F.when(pk % 250 == 7, bp * 50).otherwise(bp)
    reviews_n = F.coalesce(F.col("n_reviews"), F.lit(0))
    columns = {
        "id": pk,
        "host_id": F.col("sk"),
        "host_since": F.date_sub(
            F.lit("2001-12-31").cast("date"), ((host * 371) % 3650).cast("int")
        ),
        "host_is_superhost": F.when(host % 13 == 0, None)
        .when(F.col("s_acctbal") >= 5000, "t")
        .otherwise("f"),
        "host_response_rate": F.when(host % 17 == 0, "N/A").otherwise(
            F.concat(((host * 7) % 101).cast("string"), F.lit("%"))
        ),
        "host_response_time": _pick(RESPONSE_TIMES, host % 3),
        "host_total_listings_count": F.col("host_listings"),
        "host_identity_verified": F.when(host % 4 == 0, "f").otherwise("t"),
        "neighbourhood_cleansed": F.col("n_name"),
        "neighbourhood_group_cleansed": F.col("r_name"),
        "latitude": F.lit(40) + F.col("n_nationkey") / 100.0,
        "longitude": F.lit(-74) - F.col("n_nationkey") / 100.0,
        "property_type": F.col("p_type"),
        "room_type": _pick(ROOM_TYPES, size % 4),
        "accommodates": 1 + size % 8,
        "beds": 1 + size % 4,
        "bathrooms_text": F.when(pk % 3 == 0, "Half-bath").otherwise(
            F.concat((1 + size % 3).cast("string"), F.lit(".5 baths"))
        ),
        "bedrooms": F.when(pk % 23 != 0, size % 5),
        "amenities": F.when(size % 30 == 0, "[]").otherwise(
            F.concat(
                F.lit('["x"'), F.repeat(F.lit(', "x"'), (size % 30 - 1).cast("int")), F.lit("]")
            )
        ),
        "price": F.when(pk % 97 != 0, F.concat(F.lit("$"), F.format_number(asked, 2))),
        "minimum_nights": F.when(pk % 333 == 5, F.lit(1000)).otherwise(1 + pk % 30),
        "maximum_nights": F.lit(1125),
        "number_of_reviews": reviews_n,
        "number_of_reviews_ltm": F.coalesce(F.col("n_recent"), F.lit(0)),
        "first_review": F.col("d_first"),
        "last_review": F.col("d_last"),
        "review_scores_rating": F.when(pk % 19 != 0, 100 - 200 * F.col("disc")),
        "review_scores_cleanliness": 5 - 10 * F.col("disc"),
        "review_scores_checkin": 5 - 12.5 * F.col("tax"),
        "review_scores_communication": 5 - (F.col("ln") - 1) / F.lit(6.0),
        "review_scores_location": 3.5 + 1.5 * F.col("n_nationkey") / 24,
        "review_scores_value": 5 - F.col("q") / 25,
        "instant_bookable": F.when(pk % 2 == 0, "t").otherwise("f"),
        "reviews_per_month": reviews_n / F.lit(84.0),
    }
    shaped = base.select(*[c.cast("string").alias(name) for name, c in columns.items()])
    copies = F.when(F.col("id").cast("bigint") % 40 == 3, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return shaped.select("*", F.explode(copies).alias("copy"))


RAW = {"listings": raw_listings, "calendar": raw_calendar, "reviews": raw_reviews, "texts": raw_texts}
