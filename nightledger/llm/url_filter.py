"""URL verdicts: rules for hosts and paths, else words of the name scored by naive Bayes.

Names run words together. A unigram model, counted over the words of all page titles, splits
each letter run of host and path by Viterbi: a word costs -log of its share; an unknown one
of n letters costs as much as if its share were 10 / (words * 10**n). Host and path words
(numbers are one word, ``<n>``) are features of a multinomial naive Bayes model, hashed to
``BUCKETS``. Its labels are weak: a page is a block example if a segmented word is in
``SEEDS``, else an allow example; so words that keep company with the seeds count as well.

A rule fits its host and all subdomains if the path starts with its path; the longest wins.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and
has no words, so the prior decides; null titles add no words; repeated rows and null page_ids
get their own verdicts; without any seed word in the table every page is allowed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage

#: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
SEEDS = ["ads", "adult", "bet", "casino", "lottery", "malware", "phishing", "poker", "porn", "spam", "viagra"]
#: Size of the unigram model (the most frequent words), longest word, and feature buckets.
VOCABULARY = 50_000
LONGEST = 24
BUCKETS = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class Words:
    """Unigram model; splits a run of letters into the likeliest words."""

    def __init__(self, counts: dict[str, int]):
        self.total = float(max(1, sum(counts.values())))
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.split = lru_cache(100_000)(self._split)

    def __reduce__(self):
        return _restored, (self.total, self.cost)

    def _split(self, run: str) -> tuple[str, ...]:
        best, last = [0.0], [0]
        for end in range(1, len(run) + 1):
            found = (math.inf, 0)
            for n in range(1, min(LONGEST, end) + 1):
                cost = self.cost.get(run[end - n : end])
                if cost is None:
                    cost = math.log(self.total) + (n - 1) * math.log(10)
                found = min(found, (best[end - n] + cost, -n))
            best.append(found[0])
            last.append(-found[1])
        out, end = [], len(run)
        while end:
            out.append(run[end - last[end] : end])
            end -= last[end]
        return tuple(reversed(out))

    def features(self, host: str, path: str) -> list[str]:
        out = []
        for mark, text in (("h:", host), ("p:", path.lower())):
            for token in re.findall(r"[^\W\d_]+|\d+", text):
                out += [mark + "<n>"] if token[0].isdigit() else [mark + w for w in self.split(token)]
        return out


def _restored(total: float, cost: dict[str, float]) -> Words:
    words = Words({})
    words.total, words.cost = total, cost
    return words


def unigrams(titles: Column, pages: DataFrame, size: int = VOCABULARY) -> Words:
    """Counts of all title words, combined in each task; the most frequent make the model."""
    words = F.explode(F.filter(F.split(F.lower(titles), r"[^\p{L}]+"), lambda w: F.length(w).between(1, LONGEST)))
    counts = pages.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    return Words({w: 10 for w in SEEDS} | {r["word"]: r["n"] for r in top})


def featured(rows: DataFrame, words: Words) -> DataFrame:
    """rows (host, path, ...) with ``features``, an array of prefixed words."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("array<string>")
    def features(host: pa.Array, path: pa.Array) -> pa.Array:
        pairs = zip(host.to_pylist(), path.to_pylist(), strict=True)
        return pa.array([shared.value.features(h, p) for h, p in pairs], pa.list_(pa.string()))

    return rows.withColumn("features", features("host", "path"))


def bucket(feature: Column) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(BUCKETS)).cast("int")


def train(rows: DataFrame, alpha: float = 0.5) -> tuple[float, np.ndarray]:
    """Log prior odds of block and a log ratio for each bucket; rows: (buckets, block)."""
    sizes = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    yes, no = sizes.get(True, 0), sizes.get(False, 0)
    ratio = np.zeros(BUCKETS)
    if not yes:
        return -math.inf, ratio
    counts = np.zeros((2, BUCKETS))
    seen = rows.select("block", F.explode("buckets").alias("b")).groupBy("b", "block").agg(F.count("*").alias("n"))
    for r in seen.collect():
        counts[int(r["block"]), r["b"]] += r["n"]
    known = counts.sum(axis=0) > 0  # a bucket without an example says nothing
    counts = counts[:, known] + alpha
    counts /= counts.sum(axis=1, keepdims=True)
    ratio[known] = np.log(counts[1] / counts[0])
    return math.log(yes / max(no, alpha)), ratio


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = tuple(RULES)) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds) of pages (page_id, url, html)."""
    spark = pages.sparkSession
    words = unigrams(F.regexp_extract(F.col("html"), "(?is)<title[^>]*>(.*?)</title>", 1), pages.where("html is not null"))
    host, path = host_and_path(F.col("url"))
    rows = featured(pages.select("page_id", host.alias("host"), path.alias("path")), words)
    seeded = F.array(*[F.lit(mark + w) for mark in ("h:", "p:") for w in SEEDS])
    rows = stage(
        rows.select(
            "page_id",
            "host",
            "path",
            F.transform("features", bucket).alias("buckets"),
            F.arrays_overlap("features", seeded).alias("block"),
        )
    )
    prior, ratio = train(rows)
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def odds(buckets: pa.Array) -> pa.Array:
        sizes = pa.compute.list_value_length(buckets).to_numpy(zero_copy_only=False)
        parts = shared.value[buckets.flatten().to_numpy(zero_copy_only=False)]
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), parts, len(sizes))
        return pa.array(total + prior)

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = F.when(F.col("odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    rows = rows.withColumn("odds", odds("buckets"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, scored).alias("verdict"), "odds")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
