"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, parts_of


def components(links: DataFrame) -> DataFrame:
    """(a, b) long pairs to (node, root): root is the smallest node of the component.

    Each round hangs every larger neighbour of a node to its smallest neighbour, then every
    smaller neighbour likewise, until nothing moves; rounds grow with the logarithm of the
    longest path. Sums are combined before each shuffle, and each round is checkpointed.
    Nulls and loops are left out; nodes without a link aren't returned.
    """
    edges = cut(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state, parts = None, 2 * parts_of(edges)  # edges never become more than twice as many
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
        edges = cut(small.where("u <> v").distinct(), parts)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
