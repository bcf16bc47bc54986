"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search.

Words and five-word shingles are those of ``text.py``. A window has as many words as an item
(the whole text, if that is shorter). Fingerprints have 256 bits: the sign of the sum of the
shingles' random vectors, each as often as it occurs. Each is cut into 16 blocks of 16 bits.
If two fingerprints differ in at most ``RADIUS`` = 63 bits, one block differs in at most 3:
items are listed under all values within 2 of theirs, windows look up all values within 1 of
theirs, so every item within the radius is found. Found pairs are then compared exactly:
sum of minimum counts over sum of maximum counts of their shingles, at least ``SIMILAR``.
At that similarity a fingerprint exceeds the radius with a chance of about 1e-5.

Windows without a single shingle of an item of their size can't be similar to it and get no
fingerprint. The items travel to the tasks in blocks of at most ``ITEMS``; a larger benchmark
takes more passes over the documents.

Defined cases: null and empty texts match nothing, nor do items of fewer than five words.
Equal item rows count once. Of the windows of one text similar to an item, the most similar
is returned (ties: the first). A repeated document row gets its own result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import SHINGLE, SIMILAR, blocks, mix, shingles, words

BITS = 256
BLOCKS = 16
RADIUS = 63
ITEMS = 4096
#: Shingles whose bit sums are held at once.
SPAN = 2048

MATCH = "array<struct<item_id: bigint, similarity: double, first_word: int, words: int>>"


def _signs(h: np.ndarray) -> np.ndarray:
    """A row of BITS values of +1 or -1 for each shingle."""
    parts = mix(h[:, None] + mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64)))
    bits = np.unpackbits(parts.view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)


def _near(radius: int) -> np.ndarray:
    """All 16-bit masks of at most ``radius`` bits."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << i for i in c) for c in itertools.combinations(range(16), r)]
    return np.array(masks, np.uint16)


@dataclass
class Index:
    item_ids: np.ndarray
    #: Shingles of each item in order, and what windows of its size have.
    bags: list[tuple[np.ndarray, np.ndarray]]
    size: np.ndarray
    prints: np.ndarray
    #: Per block of bits: where the items of each value start, and the items.
    starts: list[np.ndarray]
    members: list[np.ndarray]
    #: All items' shingles, sorted, with the sizes of windows and items that hold each.
    seeds: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    maybe: np.ndarray

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the radius."""
        found = []
        for b, part in enumerate(prints.view(np.uint16).T):
            for mask in _near(1):
                value = (part ^ mask).astype(np.int64)
                lo, hi = self.starts[b][value], self.starts[b][value + 1]
                n = hi - lo
                window = np.repeat(np.arange(len(n)), n)
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(window * len(self.item_ids) + self.members[b][at])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(self.item_ids), pairs % len(self.item_ids)
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return window[near], item[near]

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """The best window for each text and similar item."""
        out: list[list[dict]] = [[] for _ in texts]
        w = words(texts)
        h, text, at = shingles(w)
        whole = w.count[text] >= SHINGLE
        h, text, at = h[whole], text[whole], at[whole]
        hit = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        row = np.searchsorted(self.seeds, h[hit])
        row[row == len(self.seeds)] = 0
        known = self.seeds[row] == h[hit]
        hit, row = hit[known], row[known]
        if not len(hit):
            return out
        n = self.first[row + 1] - self.first[row]
        place = np.repeat(hit, n)
        size = self.sizes[np.repeat(self.first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        begin = np.searchsorted(text, np.arange(len(texts) + 1))
        lo, hi = begin[text[place]], begin[text[place] + 1]
        size = np.minimum(size, hi - lo)
        best: dict[tuple[int, int], tuple] = {}
        for s in np.unique(size):
            own = size == s
            mark = np.zeros(len(h) + 1, np.int32)
            np.add.at(mark, np.maximum(place[own] - s + 1, lo[own]), 1)
            np.add.at(mark, np.minimum(place[own], hi[own] - s) + 1, -1)
            window = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            i = 0
            while i < len(window):
                j = int(np.searchsorted(window, window[i] + SPAN))
                base, part = window[i], window[i:j]
                sums = np.cumsum(_signs(h[base : part[-1] + s]), axis=0, dtype=np.int32)
                sums = np.concatenate([np.zeros((1, BITS), np.int32), sums])
                prints = _packed(sums[part - base + s] - sums[part - base])
                for k, item in zip(*self.candidates(prints), strict=True):
                    start = int(part[k])
                    similarity = bag_similarity(h[start : start + s], *self.bags[item])
                    t = int(text[start])
                    rank = (-similarity, start)
                    if similarity >= SIMILAR and rank < best.get((t, item), (1, 0))[:2]:
                        best[t, item] = (*rank, int(s))
                i = j
        for (t, item), (negative, start, s) in sorted(best.items()):
            out[t].append(
                {
                    "item_id": self.item_ids[item],
                    "similarity": -negative,
                    "first_word": int(at[start] - w.first[t]),
                    "words": s + SHINGLE - 1,
                }
            )
        return out


def bag_similarity(window: np.ndarray, e: np.ndarray, n: np.ndarray) -> float:
    own, count = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(e, own), len(e) - 1)
    both = e[at] == own
    common = np.minimum(n[at[both]], count[both]).sum()
    return float(common / (len(window) + n.sum() - common))


def build(items: list[tuple[int | None, str]]) -> Index | None:
    """Index of (item_id, text), or None if no item has five words."""
    w = words([t for _, t in items])
    h, text, _ = shingles(w)
    long_enough = np.flatnonzero(w.count >= SHINGLE)
    if not len(long_enough):
        return None
    runs = [h[text == i] for i in long_enough]
    bags = [np.unique(r, return_counts=True) for r in runs]
    prints = np.vstack([_packed(_signs(r).sum(axis=0, dtype=np.int32)[None]) for r in runs])
    size = np.array([len(r) for r in runs])
    starts, members = [], []
    masks = _near(2)
    for part in prints.view(np.uint16).T:
        value = (part[:, None] ^ masks).ravel().astype(np.int64)
        order = np.argsort(value, kind="stable")
        starts.append(np.searchsorted(value[order], np.arange(65537)))
        members.append(np.repeat(np.arange(len(runs)), len(masks))[order])
    pairs = np.unique(
        np.array([(e, s) for (own, _), s in zip(bags, size, strict=True) for e in own], dtype=[("e", "u8"), ("s", "i8")])
    )
    seeds, first = np.unique(pairs["e"], return_index=True)
    maybe = np.zeros(1 << 20, np.bool_)
    maybe[seeds >> np.uint64(44)] = True
    ids = np.array([items[i][0] for i in long_enough], object)
    return Index(ids, bags, size, prints, starts, members, seeds, np.append(first, len(pairs)), pairs["s"], maybe)


def _matched(spark: SparkSession, index: Index, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf(MATCH)
    def match(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        return pa.array([m for _, texts in blocks(batch) for m in shared.value.matches(texts)], kind)

    return match(text)


def leaks(spark: SparkSession, benchmark: DataFrame, text: Column) -> Column:
    """Array of the items found in a text, as one expression over the text column."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    passes = max(1, -(-items.count() // (ITEMS * 3 // 4)))
    found = F.array().cast(MATCH)
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        index = build(sorted(map(tuple, part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if index is not None:
            found = F.concat(found, _matched(spark, index, text))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, words): one row for each document row and item."""
    found = docs.select("doc_id", F.explode(leaks(docs.sparkSession, benchmark, F.col("text"))).alias("m"))
    return found.select("doc_id", "m.*")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, _benchmark(spark, sf_dir))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a passage of the benchmark."""
    return docs.where(F.size(leaks(spark, _benchmark(spark, sf_dir), F.col("text"))) == 0)
