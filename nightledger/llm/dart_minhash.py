"""Near-duplicate classes by DartMinHash signatures, banding and exact verification.

A text is the bag of its five-word shingles, weighted by their counts. Darts fall on each
shingle's strip of weight as a Poisson process in rank order, drawn from the shingle's hash,
so all texts see the same darts; a text keeps, for each of ``BANDS * ROWS`` coordinates, the
earliest dart below its weights. Two texts keep the same dart with the probability of their
weighted Jaccard similarity. Bands of coordinates become join keys.

Pairs aren't listed within a bucket. Equal texts are one text from the start. Every text is
first compared with the most connected text it shares a bucket with; then, round by round,
each bucket that still holds more than one component compares its members with a growing
number of its most connected texts, until all pairs of different components that share a
bucket have been decided; pairs whose signatures, sizes or distances to a common text exclude
a link need no comparison. Each comparison is the exact weighted Jaccard similarity of both
whole texts, and links of at least ``SIMILAR`` make classes by connected components. The
chance that two texts of similarity 0.8 share no band is (1 - 0.8**5)**24 = 7e-5.

Defined cases: null and empty texts are equal texts; texts without a word are alike only if
equal; a text of one to four words is one shingle. Null doc_ids take part; a class is named
by its smallest doc_id (null if it has none). Of repeated rows, the stage keeps one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .storage import cut, parts_of, stage
from .text import ODD, SIMILAR, Words, blocks, counted, mix, shingles, words

BANDS = 24
ROWS = 5
SEED = 20
#: Texts compared with one pivot in one run, and rows up to which a key list is broadcast.
RUN = 256
#: Texts of an open bucket that the others are compared with, in the first round; each round
#: takes so many times more.
PIVOTS = 8
#: Coordinates of a second signature, of the texts in shared buckets only, and how many must be
#: equal for two texts to be compared: at a similarity of 0.8, fewer are with a chance of 3e-5.
LOOK = 360
AGREEING = 258
BROADCAST_ROWS = 500_000


def _earliest(e, text, count, size: int, horizon, k: int, seed: int) -> np.ndarray:
    """Rank of the earliest dart by text and coordinate, among darts up to the text's horizon."""
    out = np.full(size * k, np.inf)
    for b in range(1 + max(0, int(np.ceil(np.log2(count.max()))))):
        low, width = (0.0, 1.0) if not b else (2.0 ** (b - 1), 2.0 ** (b - 1))
        at = np.flatnonzero(count > low) if b else np.arange(len(e))
        strip = mix(np.array([seed * 64 + b], np.uint64))
        base = mix(e[at] ^ strip)
        rank = np.zeros(len(at))
        n = 0
        while len(at):
            n += 1
            draw = mix(base + np.uint64(n))
            rank = rank - np.log(((draw >> np.uint64(11)) + 0.5) * 2.0**-53) / (k * width)
            near = rank <= horizon[text[at]]
            at, base, rank, draw = at[near], base[near], rank[near], mix(draw[near])
            coordinate = ((draw >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            height = low + width * (draw & np.uint64(0xFFFFFFFF)) * 2.0**-32
            below = height < count[at]
            np.minimum.at(out, text[at[below]] * k + coordinate[below].astype(np.int64), rank[below])
    return out.reshape(size, k)


def signatures(w: Words, k: int = BANDS * ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Rank of the dart kept at each coordinate, and the number of shingles, by text."""
    e, text, count = counted(*shingles(w)[:2])
    size = len(w.count)
    total = np.bincount(text, count, size)
    out = np.full((size, k), np.inf)
    left = np.flatnonzero(total)
    reach = np.log(k) + 4
    while len(left):  # most texts fill all coordinates at once; the others look twice as far
        place = np.full(size, -1)
        place[left] = np.arange(len(left))
        mine = place[text] >= 0
        found = _earliest(e[mine], place[text[mine]], count[mine], len(left), reach / total[left], k, seed)
        out[left] = found
        left = left[np.isinf(found).any(axis=1)]
        reach *= 2
    return out, total.astype(np.int64)


def band_keys(kept: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = kept.view(np.uint64).reshape(len(kept), -1, rows)
    key = (bits * ODD[:rows]).sum(axis=2, dtype=np.uint64)
    return mix(key + ODD[32] * np.arange(bits.shape[1], dtype=np.uint64)).view(np.int64)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, key of the text, number of shingles, band keys) of each row."""

    def run(batches):
        for batch in batches:
            for lo, texts in blocks(batch):
                kept, total = signatures(words(texts))
                keys = band_keys(kept)
                n = np.where(total > 0, keys.shape[1], 0)
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(n)]).astype(np.int32), keys[total > 0].ravel()
                )
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(total), lists], ["doc_id", "h", "total", "bands"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, total long, bands array<long>")


def looks(texts: DataFrame) -> DataFrame:
    """(h, darts): a byte for each coordinate of a second signature."""

    def run(batches):
        for batch in batches:
            for lo, texts in blocks(batch, "text"):
                kept, _ = signatures(words(texts), LOOK, SEED + 1)
                byte = (mix(kept.view(np.uint64)) >> np.uint64(56)).astype(np.uint8).view(np.int8)
                ends = np.arange(0, byte.size + 1, LOOK, dtype=np.int32)
                darts = pa.ListArray.from_arrays(ends, byte.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), darts], ["h", "darts"])

    return texts.mapInArrow(run, "h long, darts array<tinyint>")


def similarities(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, p) with texts (h, text) to (a, p, similarity); many texts with one p are spread over runs."""
    many = pairs.groupBy("p").agg(F.count("*").alias("n"))
    run = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / RUN)).alias("run")
    pairs = cut(pairs.join(many, "p").select("a", "p", run))  # read twice below
    members = pairs.join(texts, F.col("a") == F.col("h")).select("p", "run", "a", "text")
    pivots = pairs.select("p", "run").distinct().join(texts, F.col("p") == F.col("h"))
    rows = pivots.select("p", "run", F.lit(None).cast("long").alias("a"), "text").union(members)
    rows = rows.repartition("p", "run").sortWithinPartitions("p", "run", F.col("a").asc_nulls_first())

    def run(batches):
        held, pivot = (None, None)
        for batch in batches:
            a, p = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for lo, texts in blocks(batch):
                e, text, count = counted(*shingles(words(texts))[:2])
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                out = []
                for i in range(len(texts)):
                    own = e[edges[i] : edges[i + 1]], count[edges[i] : edges[i + 1]]
                    if a[lo + i] is None:
                        held, pivot = own, p[lo + i]
                    elif pivot == p[lo + i] and len(held[0]):
                        out.append((a[lo + i], pivot, jaccard(*held, *own)))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("a", "p", "similarity"), x, strict=True)) for x in out],
                    pa.schema([("a", pa.int64()), ("p", pa.int64()), ("similarity", pa.float64())]),
                )

    return rows.mapInArrow(run, "a long, p long, similarity double")


def jaccard(e: np.ndarray, n: np.ndarray, f: np.ndarray, m: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    at = np.minimum(np.searchsorted(e, f), len(e) - 1)
    both = np.flatnonzero(e[at] == f)
    common = np.minimum(n[at[both]], m[both]).sum()
    return float(common / (n.sum() + m.sum() - common))


def roots(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(h, root) of the texts that a link of at least SIMILAR binds to a different text."""
    reps = sketched.where("total > 0").groupBy("h").agg(
        F.first("bands").alias("bands"),
        F.first("total").alias("total"),
        F.min("doc_id").alias("carrier"),
    )
    rows = reps.select(F.explode("bands").alias("key"), "h")
    crowd = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(rows.join(crowd, "key"))
    ties = shared.groupBy("h").agg(F.sum("n").alias("ties"))
    known = cut(reps.join(ties, "h"))
    parts = parts_of(shared)
    shared = cut(shared.join(ties, "h").select("key", "h", "ties"), parts)
    wanted = known.select(F.col("h").alias("k"), "carrier")
    if known.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("h"), "text")
    own = (F.col("h") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("carrier"))
    texts = stage(texts.join(wanted, own).select("h", "text"))
    strength = F.struct("ties", "h")
    # round 0: each text and the most connected one that it shares a bucket with
    best = shared.groupBy("key").agg(F.max(strength).alias("best"))
    first = shared.join(best, "key").groupBy("h").agg(F.max("best").alias("best"))
    pairs = first.select(F.col("h").alias("a"), F.col("best.h").alias("p")).where("a <> p")
    decided = cut(similarities(pairs, texts))
    hubs = decided.groupBy(F.col("a").alias("h")).agg(F.first("p").alias("hub"), (1 - F.first("similarity")).alias("far"))
    known = known.join(hubs, "h", "left").join(looks(texts).dropDuplicates(["h"]), "h").select(
        "h",
        "total",
        "bands",
        "darts",
        F.coalesce("hub", "h").alias("hub"),
        F.coalesce("far", F.lit(0.0)).alias("far"),
    )
    known = cut(known, parts)
    done = None
    pivots = PIVOTS
    while True:
        comp = components(decided.where(F.col("similarity") >= SIMILAR).select("a", F.col("p").alias("b")))
        comp = comp.select(F.col("node").alias("h"), "root")
        open_ = shared.join(comp, "h", "left").withColumn("root", F.coalesce("root", "h"))
        if done is not None:
            open_ = open_.join(done, ["key", "h"], "left_anti")
        strongest = F.max(F.struct("ties", "h", "root")).alias("s")
        mixed = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), strongest)
        mixed = mixed.where("lo < hi").select("key", F.col("s.root").alias("main"))
        open_ = cut(open_.join(mixed, "key"), parts)
        if open_.isEmpty():
            return comp
        open_ = open_.join(known, "h")
        # those outside the bucket's main component come first: when they have been compared,
        # the bucket is closed; tasks keep the first of a bucket before the shuffle
        order = Window.partitionBy("key").orderBy(F.col("root") == F.col("main"), F.desc("ties"), "h")
        top = open_.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots)
        own = ("h", "root", "total", "bands", "darts", "hub", "far")
        top = cut(top.select("key", *[F.col(c).alias(f"p_{c}") for c in own]), parts)
        pairs = open_.join(top, "key").where(_may_link())
        pairs = pairs.select(F.least("h", "p_h").alias("a"), F.greatest("h", "p_h").alias("p")).distinct()
        old = decided.select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("p"))
        pairs = cut(pairs.join(old, ["a", "p"], "left_anti"), parts)
        if not pairs.isEmpty():
            decided = cut(decided.union(similarities(pairs, texts)))
        finished = top.select("key", F.col("p_h").alias("h"))
        done = cut(finished if done is None else done.union(finished), parts)
        pivots *= PIVOTS


def _may_link() -> Column:
    """What a pair of a bucket must fulfil to be compared; each is needed for a link.

    Its components differ; the smaller total is SIMILAR of the larger at least; if both were
    compared with the same hub, their distances to it differ by at most 1 - SIMILAR (the
    weighted Jaccard distance obeys the triangle inequality); AGREEING coordinates are equal.
    A pair is taken in the first bucket that it shares.
    """
    apart = F.abs(F.col("far") - F.col("p_far")) > 1 - SIMILAR + 1e-9
    size = F.least("total", "p_total") >= SIMILAR * F.greatest("total", "p_total")
    here = F.get(F.array_intersect("bands", "p_bands"), F.lit(0)) == F.col("key")
    equal = F.zip_with("darts", "p_darts", lambda a, b: (a == b).cast("int"))
    agree = F.aggregate(equal, F.lit(0), lambda n, x: n + x) >= AGREEING
    apart = (F.col("hub") == F.col("p_hub")) & apart
    return (F.col("root") != F.col("p_root")) & size & ~apart & here & agree


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root, class_id, class_size), one row per row of docs (doc_id, text)."""
    sketched = stage(sketch(docs))
    members = sketched.groupBy("h").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"))
    members = members.join(roots(docs, sketched), "h", "left").withColumn("root", F.coalesce("root", "h"))
    members = cut(members)
    named = members.groupBy("root").agg(F.min("doc").alias("class_id"), F.sum("n").alias("class_size"))
    named = members.select("root", "h").join(named, "root")
    return sketched.select("doc_id", "h").join(named, "h").select("doc_id", "h", "root", "class_id", "class_size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, text_key), one row per row of docs (doc_id, text)."""
    return classes(docs).select("doc_id", "class_id", "class_size", F.col("h").alias("text_key"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows of a class other than one: smallest doc_id (nulls last), then text key."""
    found = cut(classes(docs).where("class_size > 1").select("doc_id", "h", "root"))
    rows = found.groupBy("root", "h", "doc_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
    kept = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "h", "n"), order).alias("kept"))
    judged = cut(rows.select("root", "h").distinct().join(kept, "root").select("h", "kept"))
    named = judged.select(F.col("h").alias("__h"), F.col("kept").alias("__kept"))
    if judged.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    key = text_key(F.col("text"))
    left = docs.withColumn("__h", key).join(named, "__h", "left")
    own = (F.col("__h") == F.col("__kept.h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__kept.doc_id"))
    left = left.where(F.col("__kept").isNull() | own)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if judged.where("kept.n > 1").isEmpty():
        return left.select(*columns)
    again = F.coalesce(F.col("__kept.n") > 1, F.lit(False))
    return left.where(~again).select(*columns).unionAll(
        left.where(again).dropDuplicates(["__h", "doc_id"]).select(*columns)
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays."""
    return one_of_each(docs)
