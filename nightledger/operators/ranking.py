"""Global row numbers, dense ranks and NTILE without a single-task window.

Rows are range-partitioned on the full order, sorted, and written to the shared
checkpoint folder, so that the partition borders are fixed. The place of a row within its
partition comes with the write; one small frame with a row per partition carries the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.session import shared_dir


# monotonically_increasing_id keeps the partition above this bit and the row below it
PART_BIT = 33

#: Rows of keys that are broadcast at most, about 16 MB of ids.
BROADCAST_KEYS = 1_000_000


def held(keys: DataFrame) -> DataFrame:
    """Narrow rows to join with, broadcast up to ``BROADCAST_KEYS`` of them.

    They are counted, so give it a frame that is cheap to read: Spark's own estimate comes from
    the rows they were made of, and it would shuffle the other side before it knew better.
    """
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _placed(df: DataFrame, value: str, tie: str, descending: bool) -> DataFrame:
    """Rows in global order over range partitions, with borders fixed on disk.

    Adds ``_part`` and ``_row``, the 1-based place within the partition. ``tie`` must be
    unique, so that many equal values still spread over partitions.
    """
    shared_dir(df.sparkSession)
    key = F.col(value).desc() if descending else F.col(value).asc()
    order = [key, F.col(tie).asc()]
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    within = F.col("_place").bitwiseAND(F.lit((1 << PART_BIT) - 1)) + 1
    return numbered.select(
        *df.columns, F.shiftright("_place", PART_BIT).alias("_part"), within.alias("_row")
    )


def _with_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    # offsets has one row per range partition, a number the settings bound
    return rows.join(F.broadcast(offsets), "_part")


def global_row_numbers(
    df: DataFrame, value: str, tie: str, descending: bool = False
) -> DataFrame:
    """Add ``row_number`` and ``row_total`` over (value, tie)."""
    placed = _placed(df, value, tie, descending)
    # One row per partition: the windows are as small as the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
            F.sum("_rows").over(Window.partitionBy()).alias("row_total"),
        )
    )
    numbered = _with_offsets(placed, offsets)
    row_number = F.col("_row") + F.col("_offset")
    return numbered.select(*df.columns, row_number.alias("row_number"), "row_total")


def global_positions(df: DataFrame, value: str, tie: str, descending: bool = False) -> DataFrame:
    """Add ``row_number``, ``dense_rank`` and ``row_total`` over (value, tie)."""
    placed = _placed(df, value, tie, descending)
    key = F.col(value).desc() if descending else F.col(value).asc()
    local = placed.withColumn(
        "_dense", F.dense_rank().over(Window.partitionBy("_part").orderBy(key))
    )
    first, last = (F.max, F.min) if descending else (F.min, F.max)
    per_part = local.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("_dense").alias("_values"),
        first(value).alias("_first"),
        last(value).alias("_last"),
        F.count(value).alias("_known"),
    )
    # One row per partition: the windows below are as small as the partition count.
    parts = Window.orderBy("_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    # NULLs sort first ascending and last descending; a partition of NULLs only
    # continues the one before it when that one also borders on NULL.
    edge_first = F.when(F.col("_known") == F.col("_rows"), F.col("_first"))
    edge_last = F.when(F.col("_known") == F.col("_rows"), F.col("_last"))
    if descending:
        edge_first = F.when(F.col("_known") > 0, F.col("_first"))
    else:
        edge_last = F.when(F.col("_known") > 0, F.col("_last"))
    continues = F.when(
        F.col("_seen").isNotNull() & F.col("_edge_first").eqNullSafe(F.col("_edge_before")), 1
    ).otherwise(0)
    offsets = (
        per_part.withColumn("_edge_first", edge_first)
        .withColumn("_edge_last", edge_last)
        .withColumn("_edge_before", F.lag("_edge_last").over(parts))
        .withColumn("_seen", F.lag("_rows").over(parts))
        .withColumn("_continues", continues)
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_offset"),
            (
                F.coalesce(F.sum(F.col("_values") - F.col("_continues")).over(before), F.lit(0))
                - F.col("_continues")
            ).alias("_dense_offset"),
            F.sum("_rows").over(Window.partitionBy()).alias("row_total"),
        )
    )
    return _with_offsets(local, offsets).select(
        *df.columns,
        (F.col("_row") + F.col("_row_offset")).alias("row_number"),
        (F.col("_dense") + F.col("_dense_offset")).alias("dense_rank"),
        "row_total",
    )


def global_dense_rank(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """Add ``name``, the dense rank of ``value`` over all rows; NULL is a value of its own.

    Only the distinct values are ordered: their place is the rank. Rows are joined with them
    once, without a shuffle while Spark can broadcast the values, and otherwise with one that
    it can split where a value is frequent.
    """
    values = df.groupBy(F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_count"))
    ranked = global_row_numbers(values, "_value", "_value", descending).select(
        "_value", F.col("row_number").cast("bigint").alias(name)
    )
    return df.join(ranked, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def ntile_of(row: Column, total: Column, buckets: int) -> Column:
    """NTILE from a row number: the first ``total % buckets`` buckets hold one row more."""
    size = F.floor(total / buckets)
    extra = total % buckets
    in_large = extra * (size + 1)
    return (
        F.when(row <= in_large, F.ceil(row / (size + 1)))
        .otherwise(extra + F.ceil(F.try_divide(row - in_large, size)))
        .cast("bigint")
    )


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, kind: str, name: str):
    """Best ``n`` rows of each group by row_number, rank or dense_rank.

    The filter on the rank lets each task drop the rows that cannot qualify before the
    shuffle, so that a hot group arrives already reduced.
    """
    number = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[kind]
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, number().over(window)).where(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of every key under a total order."""
    return top_per_group(df, keys, order, 1, "row_number", "_n").drop("_n")


def _repeated(df: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """The keys that occur more than once, under their new names, written for those who count them."""
    shared_dir(df.sparkSession)
    counted = df.groupBy(*renamed).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > 1).drop("_n").withColumnsRenamed(renamed).checkpoint()


def first_per_key_wide(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``first_per_key`` for rows with long texts.

    Repeated keys are found on the keys alone. Rows whose key occurs once, normally
    nearly all, are passed on without being shuffled.
    """
    renamed = {c: f"_repeated_{c}" for c in keys}
    repeated = held(_repeated(df, renamed))
    match = [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()]
    again = first_per_key(df.join(repeated, match, "left_semi"), keys, order)
    return df.join(repeated, match, "left_anti").unionByName(again)


def first_per_key_placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``first_per_key_wide`` where ``order`` is different for any two rows.

    Repeated keys are found on keys alone, and their survivors on keys and places of these. One
    join then takes the others out, so texts are shuffled once at most, and not at all while there
    are few enough repeated keys to broadcast.
    """
    place = F.struct(*order)
    renamed = {c: f"_repeated_{c}" for c in keys}
    match = [F.col(c).eqNullSafe(F.col(r)) for c, r in renamed.items()]
    firsts = (
        df.join(held(_repeated(df, renamed)), match, "left_semi")
        .groupBy(*[F.col(c).alias(r) for c, r in renamed.items()])
        .agg(F.min(place).alias("_first"))
        .checkpoint()
    )
    # the left row is kept if its key isn't repeated, or if it is the first of its key
    kept = F.col("_first").isNull() | place.eqNullSafe(F.col("_first"))
    return df.join(held(firsts), match, "left").where(kept).drop("_first", *renamed.values())


def percent_rank_of(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """PERCENT_RANK over all rows: (rank - 1) / (rows - 1), 0 for a single row."""
    placed = global_positions(df, value, tie)
    starts = placed.groupBy("dense_rank").agg(F.min("row_number").alias("_rank"))
    return (
        placed.join(starts, "dense_rank")
        .withColumn(
            name,
            F.coalesce(
                F.try_divide(
                    (F.col("_rank") - 1).cast("double"), (F.col("row_total") - 1).cast("double")
                ),
                F.lit(0.0),
            ),
        )
        .drop("dense_rank", "row_number", "row_total", "_rank")
    )
