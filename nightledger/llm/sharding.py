"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. Each partition permutes its rows (random keys, local sort) and numbers them; the rows'
   numbers are checkpointed, so that a lost executor can't deal them differently.
2. How many rows of partition i go to shard j is drawn from the law that a uniform shuffle
   has: multivariate hypergeometric, with the given row and column sums. The driver draws
   for groups of partitions, one task per group draws within it, so that neither holds the
   whole matrix (about ``sqrt(partitions) * shards`` numbers each).
3. The first rows of each permuted partition go to shard 0, the next to shard 1, and so on.
4. Each shard is permuted again: rows are numbered by a second random key, within bins of
   that key that hold about ``BIN_ROWS`` rows, plus the rows of the bins before.

Law ``rows``: shard sizes are exact and differ by one at most, the first shards being the
larger. Any assignment with these sizes is equally likely, given the generator (where more
than a billion rows meet in one draw, up to the normal approximation of its count). The seed
fixes the draws for a given partitioning of the input.

Defined cases: null and empty texts have one byte (their end) and checksum 0; repeated rows
and null doc_ids are dealt like others; an empty table gives no rows; with fewer rows than
shards some shards are empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut, stage

SHARDS = 8
SEED = 9
BIN_ROWS = 50_000
#: Bytes of the matrix up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards)


def matrix(sizes: list[int], columns: np.ndarray, seed: int) -> np.ndarray:
    """Counts with the given row and column sums, as a uniform shuffle would deal them."""
    draw = np.random.default_rng(seed)
    left = np.array(columns, np.int64)
    out = np.zeros((len(sizes), len(left)), np.int64)
    for i, n in enumerate(sizes):
        # one column after the other, each by the univariate law
        rest, wanted = int(left.sum()), int(n)
        for j, m in enumerate(left.copy()):
            rest -= int(m)
            out[i, j] = _hypergeometric(draw, int(m), rest, wanted)
            wanted -= int(out[i, j])
        left -= out[i]
    return out


def _hypergeometric(draw, good: int, bad: int, sample: int) -> int:
    """numpy's draw; its normal approximation where a count exceeds numpy's limit of 1e9."""
    if not good or not sample:
        return 0
    if good + bad == sample:
        return good
    if max(good, bad, sample) < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, sample))
    n = good + bad
    mean = sample * good / n
    spread = np.sqrt(mean * (bad / n) * ((n - sample) / max(n - 1, 1)))
    return int(np.clip(round(draw.normal(mean, spread)), max(0, sample - bad), min(good, sample)))


def cuts(spark: SparkSession, counted: list[tuple[int, int]], shards: int, seed: int) -> DataFrame:
    """(block, cuts): the row number at which each shard's share of a partition ends."""
    counted = sorted(counted)
    width = max(1, int(np.ceil(np.sqrt(len(counted)))))
    groups = [counted[i : i + width] for i in range(0, len(counted), width)]
    sizes = shard_sizes(sum(n for _, n in counted), shards)
    dealt = matrix([sum(n for _, n in g) for g in groups], sizes, seed)
    rows = [
        (i, [b for b, _ in g], [n for _, n in g], [int(x) for x in dealt[i]]) for i, g in enumerate(groups)
    ]

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        g = frame.iloc[0]
        part = matrix(list(g["sizes"]), np.array(g["dealt"]), [seed, int(g["part"]) + 1])
        return pd.DataFrame({"block": list(g["blocks"]), "cuts": list(np.cumsum(part, axis=1))})

    frame = spark.createDataFrame(rows, "part long, blocks array<long>, sizes array<long>, dealt array<long>")
    return frame.groupBy("part").applyInPandas(within, "block long, cuts array<long>")


def permuted(rows: DataFrame, seed: int) -> DataFrame:
    """rows with __block and __place (number in the permuted partition) and a second key __again."""
    mixed = rows.withColumn("__first", F.rand(seed)).withColumn("__again", F.rand(seed + 1))
    mixed = mixed.sortWithinPartitions("__first").withColumn("__n", F.monotonically_increasing_id())
    place = F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    mixed = mixed.withColumn("__block", F.shiftright("__n", 33)).withColumn("__place", place)
    return mixed.drop("__first", "__n")


def deal(held: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows of ``permuted`` (written before) with shard and slot."""
    spark = held.sparkSession
    counted = [(r[0], r[1]) for r in held.groupBy("__block").count().collect()]
    total = sum(n for _, n in counted)
    if not total:
        return held.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).drop("__block", "__place", "__again")
    table = cuts(spark, counted, shards, seed).select(F.col("block").alias("__block"), "cuts")
    if len(counted) * shards * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    held = held.join(table, "__block")
    shard = F.size(F.filter("cuts", lambda end: end <= F.col("__place")))
    bins = max(1, total // shards // BIN_ROWS)
    held = held.withColumn("shard", shard).withColumn("__bin", F.floor(F.col("__again") * bins))
    sums = cut(held.groupBy("shard", "__bin").agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "__bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("shard", "__bin").orderBy("__again", "__block", "__place")
    held = held.join(sums, ["shard", "__bin"]).withColumn("slot", F.col("__before") + F.row_number().over(order) - 1)
    return held.drop("__block", "__place", "__again", "__bin", "__before", "cuts")


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0); columns of these names are replaced."""
    if shards < 1:
        raise ValueError("at least one shard")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")]
    dealt = deal(stage(permuted(rows.select(*kept), seed)), shards, seed)
    return dealt.select(*kept, "shard", "slot")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    dealt = shuffle_into_shards(rows)
    return dealt.select("*", F.lit(None).cast("int").alias("grown_shard"))


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents with shard and slot."""
    return shuffle_into_shards(docs)
