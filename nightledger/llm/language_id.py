"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each character from the ``ORDER - 1`` before it. Texts are
lower-cased, every run of other characters than letters becomes one space, and the text
starts as if spaces stood before it. The n-grams of all languages lie in one sorted hash
array per order, with a column of log probabilities per language. The language with the
lowest cross-entropy per character wins (ties: the first by name).

Rejection is calibrated on labelled rows that the counts didn't see: a text is rejected if
its cross-entropy exceeds the language's median by more than MARGIN times what 999 of 1000
of those rows reach, at its length.

Defined cases: a null, empty or letterless text gets ``und`` with score 0 and is rejected;
without any labelled row every text does. Null languages and null doc_ids aren't learned
from. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ODD, blocks, codes, mix

ORDER = 4
#: About so many labelled rows of each language are learned from, chosen by a hash of doc_id.
TRAIN_ROWS = 4000
#: One in so many of them calibrates the rejection instead.
CALIBRATE = 5
MARGIN = 4.0
#: Beyond so many characters, a longer text isn't judged more strictly.
LENGTH = 400
UNKNOWN = "und"
SPACE = np.uint32(32)


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return letter, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1 << 40))


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters with spaces squeezed, the text of each, and its place in the text."""
    point, ends = codes(texts)
    letter, _ = _alphabet()
    is_letter = letter[point]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first other character after a letter is the space
    at = np.flatnonzero(keep)
    point = np.where(is_letter[at], point[at], SPACE)
    text = np.searchsorted(ends, at, "right")
    count = np.bincount(text, minlength=len(texts))
    place = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    return point, text, place


def _values(point: np.ndarray, place: np.ndarray, back: int) -> np.ndarray:
    """Value of the character that stands ``back`` before each place; spaces stand before a text."""
    value = _alphabet()[1]
    out = np.full(len(point), value[SPACE])
    out[back:] = value[point[: len(point) - back]]
    out[place < back] = value[SPACE]
    return out


def _hash(values: list[np.ndarray], n: int, at: np.ndarray | None = None, back: int = 0) -> np.ndarray:
    """Hash of the n characters that end ``back`` before each place."""
    h = np.zeros(len(values[0]) if at is None else len(at), np.uint64)
    for j in range(n):
        h += (values[j + back] if at is None else values[j + back][at]) * ODD[j]
    return h


@dataclass
class Table:
    """Sorted hashes with a row of values for each, found by the upper bits; the last row is zero."""

    keys: np.ndarray
    values: np.ndarray
    bits: int = field(init=False)
    start: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.values = np.vstack([self.values[order], 0 * self.values[:1]]).astype(np.float32)
        self.bits = min(20, max(1, int(len(self.keys)).bit_length() + 2))
        edges = np.arange((1 << self.bits), dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.append(np.searchsorted(self.keys, edges), len(self.keys)).astype(np.int32)
        self.longest = int(np.diff(self.start).max())
        self.keys = np.append(self.keys, np.uint64(0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        bucket = h >> np.uint64(64 - self.bits)
        at, last = self.start[bucket], self.start[bucket + np.uint64(1)]
        found = np.where((self.keys[at] == h) & (at < last), at, -1)
        for t in range(1, self.longest):
            open_ = np.flatnonzero((found < 0) & (at + t < last))
            if not len(open_):
                break
            hit = open_[self.keys[at[open_] + t] == h[open_]]
            found[hit] = at[hit] + t
        return found


@dataclass
class Model:
    languages: list[str]
    order: int
    #: By n: log probabilities of n-grams, and the log weight that a context leaves to shorter ones.
    grams: list[Table]
    contexts: list[Table]
    unseen: np.ndarray
    median: np.ndarray
    limit: np.ndarray

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats of each text under each language; characters of each text."""
        point, text, place = _characters(texts)
        size = np.bincount(text, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        if not len(point) or not self.languages:
            return out, size
        values = [_values(point, place, back) for back in range(self.order)]
        row = self.grams[-1].find(_hash(values, self.order))
        log_p = self.grams[-1].values[row]
        left = np.flatnonzero(row < 0)
        for n in range(self.order - 1, -1, -1):  # an unknown n-gram: what its context leaves to shorter ones
            weight = self.contexts[n].values[self.contexts[n].find(_hash(values, n, left, back=1))]
            if not n:
                log_p[left] += weight + self.unseen
                break
            row = self.grams[n - 1].find(_hash(values, n, left))
            log_p[left] += weight + self.grams[n - 1].values[row]
            left = left[row < 0]
        first = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[first]] = -np.add.reduceat(log_p, first, axis=0, dtype=np.float64) / size[text[first], None]
        return out, size

    def judge(self, texts: list[str]) -> pd.DataFrame:
        h, size = self.entropies(texts)
        best = h.argmin(axis=1) if self.languages else np.zeros(len(texts), int)
        rows = np.arange(len(texts))
        known = (size > 0) & bool(self.languages)
        if not self.languages:
            h, names = np.zeros((len(texts), 1)), np.array([UNKNOWN], object)
            median, limit = np.zeros(1), np.zeros(1)
        else:
            names, median, limit = np.array(self.languages, object), self.median, self.limit
        lowest = h[rows, best]
        odds = np.exp(np.maximum(-(h - lowest[:, None]) * size[:, None], -700)).sum(axis=1)
        excess = (lowest - median[best]) * np.sqrt(np.minimum(size, LENGTH))
        return pd.DataFrame(
            {
                "lang_pred": np.where(known, names[best], UNKNOWN),
                "score": np.where(known, 1.0 / odds, 0.0),
                "cross_entropy": np.where(known, lowest, np.nan),
                "excess": np.where(known, excess, np.nan),
                "accepted": known & (excess <= limit[best]),
            }
        )


def build(counts: pd.DataFrame, order: int = ORDER) -> Model:
    """Model from (lang, gram, n): n-grams of the highest order and how often each occurs."""
    languages = sorted(counts["lang"].unique())
    none = np.zeros(len(languages))
    if not languages:
        return Model([], order, [], [], none, none, none)
    value = _alphabet()[1]

    def hashed(grams: list[str], n: int) -> np.ndarray:
        if not n:
            return np.zeros(len(grams), np.uint64)
        point = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, n)
        return sum((value[point[:, n - 1 - j]] * ODD[j] for j in range(n)), np.zeros(len(point), np.uint64))

    wide = counts.pivot_table(index="gram", columns="lang", values="n", aggfunc="sum", fill_value=0)
    by_order = {order: wide[languages].astype(float)}
    for n in range(order - 1, 0, -1):  # in how many longer n-grams each one ends
        above = by_order[n + 1]
        by_order[n] = (above > 0).astype(float).groupby(above.index.str[1:]).sum()
    alphabet = len(by_order[1]) + 1
    lower = np.full((1, len(languages)), 1.0 / alphabet)
    unseen = np.log(lower[0])
    index = pd.Index([""])
    grams, contexts = [], []
    for n in range(1, order + 1):
        c = by_order[n]
        once, twice = (c == 1).sum().to_numpy(), (c == 2).sum().to_numpy()
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        before = c.index.str[:-1]
        total = c.groupby(before).sum()
        types = (c > 0).groupby(before).sum()
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        row = total.index.get_indexer(before)
        kept = np.maximum(c.to_numpy() - discount, 0) / np.maximum(total.to_numpy()[row], 1)
        p = kept + weight[row] * lower[index.get_indexer(c.index.str[1:])]
        grams.append(Table(hashed(list(c.index), n), np.log(p)))
        contexts.append(Table(hashed(list(total.index), n - 1), np.log(weight)))
        lower, index = p, c.index
    return Model(languages, order, grams, contexts, unseen, none, none + np.inf)


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, lang) to (lang, gram, n), summed in each task before the shuffle."""

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, texts in blocks(batch):
                point, text, place = _characters(texts)
                if not len(point):
                    continue
                h = _hash([_values(point, place, back) for back in range(order)], order)
                of = np.array(langs[lo : lo + len(texts)], object)[text]
                for lang in set(of):
                    at = np.flatnonzero(of == lang)
                    _, first, n = np.unique(h[at], return_index=True, return_counts=True)
                    at = at[first]
                    letters = np.stack(
                        [np.where(place[at] >= j, point[np.maximum(at - j, 0)], SPACE) for j in range(order - 1, -1, -1)],
                        axis=1,
                    )
                    grams = letters.astype("<u4").tobytes().decode("utf-32-le")
                    grams = [grams[i : i + order] for i in range(0, len(grams), order)]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": pa.array(n, pa.int64())})

    found = rows.select("text", "lang").mapInArrow(count, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def judged(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang_pred, score, cross_entropy, excess, accepted) of a text column."""
    shared = spark.sparkContext.broadcast(model)
    kind = "lang_pred string, score double, cross_entropy double, excess double, accepted boolean"

    @F.arrow_udf(kind)
    def judge(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [shared.value.judge(texts) for _, texts in blocks(batch)]
        frame = pd.concat(parts) if parts else shared.value.judge([])
        types = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        arrays = [pa.array(frame[c].to_numpy(), t, from_pandas=True) for c, t in zip(frame, types, strict=True)]
        return pa.StructArray.from_arrays(arrays, list(frame))

    return judge(text)


def bucket(doc_id: Column) -> Column:
    """Remainder 0 to 4 by which rows are held out; null: 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def fit(docs: DataFrame, order: int = ORDER, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows of remainder 1 to 4: ``train_rows`` of each language or so."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id")) != 0))
    rows = rows.select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return build(pd.DataFrame({"lang": [], "gram": [], "n": []}), order)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_rows / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    rows = rows.where(draw < shares[F.col("lang")])
    tuning = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) == 0
    model = build(gram_counts(rows.where(~tuning), order).toPandas(), order)
    seen = rows.where(tuning).select("lang", judged(spark, model, F.col("text")).alias("j"))
    seen = seen.where((F.col("lang") == F.col("j.lang_pred"))).groupBy("lang").agg(
        F.percentile_approx("j.cross_entropy", F.lit(0.5), F.lit(10_000)).alias("median"),
        F.collect_list(F.struct("j.cross_entropy", "j.excess")).alias("rows"),
    )
    # excess was taken from a median of 0, so that of a row is excess - median * excess / cross_entropy
    seen = seen.withColumn("excesses", F.expr("transform(rows, r -> r.excess * (1 - median / r.cross_entropy))"))
    seen = seen.select("lang", "median", F.expr("array_sort(excesses)[int((size(excesses) - 1) * 0.999)]").alias("high"))
    for r in seen.collect():
        at = model.languages.index(r["lang"])
        model.median[at] = r["median"]
        model.limit[at] = MARGIN * max(r["high"], 1.0)
    return model


def identify(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """docs with a struct column ``into`` (one of that name is replaced)."""
    return docs.withColumn(into, judged(docs.sparkSession, model, F.col("text")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select(
        "doc_id",
        (bucket(F.col("doc_id")) == 0).alias("held_out"),
        "language.lang_pred",
        "language.score",
        "language.cross_entropy",
        "language.accepted",
    )


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that aren't rejected."""
    return docs.where(judged(spark, fit(docs), F.col("text"))["accepted"])
