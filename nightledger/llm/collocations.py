"""Phrases of two and three words that occur together, counted by broadcast double-array tries.

Words are counted first. Candidates grow as in Apriori: a pair of frequent words, a triple of
two frequent pairs. Pairs and triples whose parts are frequent are found by sums of packed word
numbers, one row for each distinct one of a block. All that reach ``LEAST`` go into one double
array: a state for every frequent word, then one transition for each digit (base ``RADIX``) of
the next word's number. A last pass over all texts advances the states of every position of a
block at once, digit by digit, and bincounts the accepting ones; Spark adds the tasks' counts.

A trie takes at most RADIX + 2 * digits slots of 12 bytes for each of ``PHRASES`` candidates.
Where there are more candidates, the sums that find them are the counts (``counted_by_numbers``): a
triple is three word numbers in one, and most of those with a rare pair are left out by a bitmap of
fixed size that holds all frequent pairs. Where there are more than ``WORDS`` frequent words, the phrases
are counted by a plain shuffle of all phrases (``counted_by_shuffle``). Each way has the same result.

Scores are products of decimals with 38 digits: exact while 1000000 * a * a is below 1e38.

Defined cases: null texts are empty; a null lang is ``und``, together with documents that say
so; an empty lang is a lang; only A-Z are lower-cased; texts without words give nothing; repeated
rows count as often as they occur; ties go by the stated order, which is total; an empty table
gives no rows; only lang and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut, stage

#: Occurrences of a candidate; percent of them inside a longer one that drop it; rows of a lang.
LEAST = 10
INSIDE = 50
TOP = 2000
#: Frequent words, and candidates, that a task holds. A word's number has BITS, so that three fit into a long.
WORDS = 2_000_000
PHRASES = 2_000_000
BITS = 21
#: Binary logarithm of the bits that tell which pairs may be frequent (32 MB).
SIEVE = 28
RADIX = 16
#: Bytes of text that are turned into arrays at once (a longer text is a block alone).
BLOCK_BYTES = 1 << 22
#: Parts of a lang whose best rows are taken before those of the lang.
SALTS = 64

_TEXT = pa.large_string()
_PIECE, _SPACE = 2, 1
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _PIECE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _blocks(batches) -> Iterator[tuple[str, pa.Array]]:
    """Lang and texts, each closed by a line break, in blocks of bounded length."""
    for batch in batches:
        langs = batch.column(0).fill_null("und")
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column(1).filter(pc.equal(langs, lang)).fill_null("")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(texts):
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
                yield lang, pc.binary_join_element_wise(texts.slice(lo, hi - lo).cast(_TEXT), pa.scalar("\n", _TEXT), pa.scalar("", _TEXT))
                lo = hi


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each word its number in the block's list, that list, and whether the next word is of the same piece."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, bool)
    _, ends, data = texts.buffers()
    lo, hi = np.frombuffer(ends, np.int64)[[texts.offset, texts.offset + len(texts)]]
    point = _LOWER[np.frombuffer(data, np.uint8)[lo:hi]]
    kind = _KIND[point]
    inside = kind == 0
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    piece = np.cumsum(kind == _PIECE)[start] if len(start) else start
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    listed = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(point[inside])])
    coded = listed.dictionary_encode()
    joined = np.zeros(len(start), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, joined


def _as_text(values: pa.Array) -> pa.Array:
    return values.cast(pa.large_binary()).view(pa.large_string()).cast(pa.string())


def _counted_words(batches):
    """(lang, word, n); a null word has the number of words."""
    for lang, texts in _blocks(batches):
        code, known, _ = words(texts)
        if not len(code):
            continue
        counts = np.append(np.bincount(code, minlength=len(known)), len(code))
        listed = pa.concat_arrays([_as_text(known), pa.nulls(1, pa.string())])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), listed, pa.array(counts, pa.int64())], ["lang", "word", "n"])


class Vocabulary:
    """The frequent words by lang; numbers run through all langs."""

    def __init__(self, rows: pa.Table):
        self.listed = rows.column("word").combine_chunks().cast(pa.large_binary())
        self.langs = rows.column("lang").combine_chunks()
        first: dict[str, int] = {}
        for i, lang in enumerate(self.langs.to_pylist()):
            first.setdefault(lang, i)
        ends = [*first.values(), len(self.listed)][1:]
        self.of = {lang: (lo, hi - lo) for (lang, lo), hi in zip(first.items(), ends, strict=True)}

    def numbers(self, lang: str, code: np.ndarray, known: pa.Array) -> np.ndarray:
        """The number of each word of a block, -1 for the rare."""
        lo, n = self.of.get(lang, (0, 0))
        found = pc.index_in(known, value_set=self.listed.slice(lo, n)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(found >= 0, found + lo, -1)[code] if len(code) else code


class Trie:
    """A double array over pairs and triples of word numbers.

    ``check[base[s] + digit] == s`` holds for the transitions; ``index`` numbers accepting states.
    Children of a state with several get slots of their own in a row, as wide as their digits
    lie apart; children of the others fill the slots left between.
    """

    def __init__(self, n_words: int, pairs: np.ndarray, triples: np.ndarray):
        """pairs: rows of two numbers; triples: rows of the place of a pair and a number."""
        self.digits = 1
        while RADIX**self.digits < n_words:
            self.digits += 1
        first = max(n_words, RADIX)
        self.base = np.zeros(first, np.int32)
        self.check = np.full(first, -1, np.int32)
        self._free = np.zeros(0, np.int64)
        ends = self._added(pairs[:, 0], pairs[:, 1])
        more = self._added(ends[triples[:, 0]], triples[:, 1])
        self._grow(RADIX)
        self.index = np.full(len(self.base), -1, np.int32)
        self.index[ends] = np.arange(len(ends))
        self.index[more] = len(ends) + np.arange(len(more))
        self.size = len(ends) + len(more)

    def _grow(self, n: int) -> None:
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])

    def _digit(self, number: np.ndarray, k: int) -> np.ndarray:
        return number // RADIX ** (self.digits - 1 - k) % RADIX

    def _added(self, state: np.ndarray, number: np.ndarray) -> np.ndarray:
        state = state.astype(np.int64)
        for k in range(self.digits):
            state = self._children(state, self._digit(number, k))
        return state

    def _children(self, state: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """The states that follow; equal (state, digit) share one."""
        if not len(state):
            return state
        key, back = np.unique(state * RADIX + digit, return_inverse=True)
        parent, sign = key // RADIX, key % RADIX
        lo = np.flatnonzero(np.diff(parent, prepend=-1))
        hi = np.append(lo[1:], len(parent))
        least, span = sign[lo], sign[hi - 1] - sign[lo] + 1
        several = hi - lo > 1
        begin = len(self.base)
        width = np.where(several, span, 0)
        place = begin + np.cumsum(width) - width  # of the least child
        self._grow(int(width.sum()))
        of = np.repeat(np.arange(len(lo)), hi - lo)
        taken = several[of]
        slot = place[of] + sign - least[of]
        used = np.zeros(len(self.base) - begin, bool)
        used[slot[taken] - begin] = True
        self._free = np.concatenate([self._free, begin + np.flatnonzero(~used)])
        alone = np.flatnonzero(~several)
        short = len(alone) - len(self._free)
        if short > 0:
            self._free = np.concatenate([self._free, len(self.base) + np.arange(short)])
            self._grow(short)
        place[alone], self._free = self._free[: len(alone)], self._free[len(alone) :]
        slot = place[of] + sign - least[of]
        self.base[parent[lo]] = place - least
        self.check[slot] = parent
        return slot[back]

    def advance(self, at: np.ndarray, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose state accepts the number (one for each position), and their states."""
        for k in range(self.digits):
            if not len(at):
                break
            follow = self.base[state] + self._digit(number, k)
            held = self.check[follow] == state
            at, state, number = at[held], follow[held].astype(np.int64), number[held]
        return at, state


def _next(at: np.ndarray, number: np.ndarray, joined: np.ndarray, step: int) -> np.ndarray:
    """Which positions have a frequent word step words on, in the same piece."""
    inside = at + step < len(number)
    place = np.where(inside, at + step, 0)
    return inside & joined[place - 1] & (number[place] >= 0)


def _pairs(number: np.ndarray, joined: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(number >= 0)
    return at[_next(at, number, joined, 1)]


def matched(trie: Trie, number: np.ndarray, joined: np.ndarray):
    """Positions and states of the pairs, then of the triples."""
    at = _pairs(number, joined)
    at, state = trie.advance(at, number[at], number[at + 1])
    yield at, state
    on = _next(at, number, joined, 2)
    at, state = at[on], state[on]
    yield trie.advance(at, state, number[at + 2])


def _summed(rows: DataFrame, step, least: int) -> DataFrame:
    """step: batches to (key, n) arrays; sums of at least ``least``."""

    def run(batches):
        for key, n in step(batches):
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {least}")


def _listed(found: DataFrame, bound: int) -> np.ndarray | None:
    """The keys, sorted; None if there are more than bound."""
    if found.count() > bound:
        return None
    return np.sort(found.select("key").toArrow().column("key").to_numpy())


def _halves(key: np.ndarray) -> np.ndarray:
    return np.stack([key >> 32, key & 0xFFFFFFFF], axis=1)


def _spelled(phrases: DataFrame, numbers, vocabulary) -> DataFrame:
    """(lang, phrase, k, a) of (key, n); numbers: keys to places and word numbers, for k = 2 and 3."""

    def run(batches):
        known, langs = vocabulary.value.listed, vocabulary.value.langs
        for batch in batches:
            for k, (at, words) in enumerate(numbers(batch.column(0).to_numpy()), 2):
                if not len(at):
                    continue
                phrase = pc.binary_join_element_wise(*(known.take(pa.array(words[:, j])) for j in range(k)), pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(words[:, 0])), _as_text(phrase), pa.array(np.full(len(at), k, np.int32)), batch.column(1).take(pa.array(at))],
                    ["lang", "phrase", "k", "a"],
                )

    return phrases.mapInArrow(run, "lang string, phrase string, k int, a long")


def _bit(pair: np.ndarray) -> np.ndarray:
    """The place of a pair in the sieve."""
    return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SIEVE)).astype(np.int64)


def sieve(pairs: DataFrame) -> np.ndarray:
    """Bytes with a bit for each of the pairs (key), of a fixed size however many there are."""

    def run(batches):
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.int64(1) << (bit & 63))], ["at", "bits"])

    rows = pairs.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(1 << SIEVE - 6, np.int64)
    held[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return held


def counted_by_numbers(rows: DataFrame, numbered, found: DataFrame, vocabulary, least: int) -> DataFrame:
    """(lang, phrase, k, a) by sums of packed word numbers, for any number of phrases; found: (key, n) of the frequent pairs."""
    may = rows.sparkSession.sparkContext.broadcast(sieve(found))

    def triples(batches):
        for number, joined in numbered(batches):
            at = _pairs(number, joined)
            bit = _bit(number[at] << 32 | number[at + 1])
            at = at[may.value[bit >> 6] >> (bit & 63) & 1 == 1]
            at = at[:-1][np.diff(at) == 1]  # a pair at a word and at the next one
            yield np.unique(number[at] << 2 * BITS | number[at + 1] << BITS | number[at + 2], return_counts=True)

    def two(key):
        return [(np.arange(len(key)), _halves(key))]

    def three(key):
        words = np.stack([key >> 2 * BITS, key >> BITS & (1 << BITS) - 1, key & (1 << BITS) - 1], axis=1)
        return [(np.zeros(0, np.int64), None), (np.arange(len(key)), words)]

    return _spelled(found, two, vocabulary).unionAll(_spelled(_summed(rows, triples, least), three, vocabulary))


def counted_by_tries(rows: DataFrame, frequent: DataFrame, least: int, n_words: int, n_phrases: int) -> DataFrame | None:
    """(lang, phrase, k, a) of the phrases of 2 and 3 words, beyond ``n_phrases`` by ``counted_by_numbers``; None beyond ``n_words``."""
    context = rows.sparkSession.sparkContext
    if frequent.count() > min(n_words, 1 << BITS):
        return None
    vocabulary = Vocabulary(frequent.orderBy("lang", F.desc("n"), "word").select("lang", "word").toArrow())
    size = len(vocabulary.listed)
    shared = context.broadcast(vocabulary)

    def numbered(batches):
        for lang, texts in _blocks(batches):
            code, known, joined = words(texts)
            yield shared.value.numbers(lang, code, known), joined

    def pairs(batches):
        for number, joined in numbered(batches):
            at = _pairs(number, joined)
            yield np.unique(number[at] << 32 | number[at + 1], return_counts=True)

    of_two = cut(_summed(rows, pairs, least))
    found = _listed(of_two, n_phrases)
    if found is None:
        return counted_by_numbers(rows, numbered, of_two, shared, least)
    two = _halves(found)
    of_pairs = context.broadcast(Trie(size, two, np.zeros((0, 2), np.int64)))

    def triples(batches):
        trie = of_pairs.value
        for number, joined in numbered(batches):
            at, state = next(matched(trie, number, joined))
            both = np.flatnonzero(np.diff(at) == 1)  # a pair at a word and at the next one
            at, state = at[both], state[both]
            yield np.unique(trie.index[state].astype(np.int64) << 32 | number[at + 2], return_counts=True)

    of_three = cut(_summed(rows, triples, least))
    found = _listed(of_three, n_phrases - len(two))
    of_pairs.unpersist()
    if found is None:
        return counted_by_numbers(rows, numbered, of_two, shared, least)
    three = _halves(found)
    trie = context.broadcast(Trie(size, two, three))

    def counts(batches):
        total = None
        for number, joined in numbered(batches):
            total = np.zeros(trie.value.size, np.int64) if total is None else total
            for _, state in matched(trie.value, number, joined):
                total += np.bincount(trie.value.index[state], minlength=len(total))
        if total is not None:
            key = np.flatnonzero(total)
            yield key, total[key]

    listed = context.broadcast((two, three))

    def numbers(key):
        two, three = listed.value
        for own in (key < len(two), key >= len(two)):
            at = np.flatnonzero(own)
            triple = three[key[at] - len(two)] if len(at) and key[at[0]] >= len(two) else None
            yield at, two[key[at]] if triple is None else np.hstack([two[triple[:, 0]], triple[:, 1:]])

    return _spelled(_summed(rows, counts, least), numbers, shared)


def counted_by_shuffle(rows: DataFrame, least: int) -> DataFrame:
    """The same by a shuffle of all phrases, for any number of them."""
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    piece = rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(lowered, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    split = piece.select("lang", F.filter(F.split("piece", r"[\x20\x09]+"), lambda w: w != "").alias("w"))

    def runs(k: int) -> DataFrame:
        each = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
        return split.where(F.size("w") >= k).select("lang", F.explode(each).alias("phrase"), F.lit(k).alias("k"))

    return runs(2).union(runs(3)).groupBy("lang", "phrase", "k").agg(F.count(F.lit(1)).alias("a")).where(f"a >= {least}")


def scored(single: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) by each candidate's lowest cut."""
    known = single.select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    known = known.union(phrases.where("k = 2").select("lang", "phrase", "a"))
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    front, back = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    short = F.array(F.struct(F.lit(1).alias("cut"), first.alias("left"), last.alias("right")))
    long = F.array(
        F.struct(F.lit(1).alias("cut"), first.alias("left"), back.alias("right")),
        F.struct(F.lit(2).alias("cut"), front.alias("left"), last.alias("right")),
    )
    cuts = phrases.select("lang", "phrase", "k", "a", F.explode(F.when(F.col("k") == 2, short).otherwise(long)).alias("c")).select("lang", "phrase", "k", "a", "c.*")
    left = known.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    a, product = (f"CAST({x} AS DECIMAL(19, 0))" for x in ("a", "l"))
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({a} * {a})) DIV ({product} * CAST(r AS DECIMAL(19, 0)))")
    best = joined.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, n_words: int = WORDS, n_phrases: int = PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each lang."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counted_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stage(counted.where(F.col("word").isNull() | (F.col("n") >= least)))
    total = counted.where("word IS NULL").select("lang", "n")
    frequent = counted.where("word IS NOT NULL")
    phrases = counted_by_tries(rows, frequent, least, n_words, n_phrases)
    phrases = stage(counted_by_shuffle(rows, least) if phrases is None else phrases)
    back, front = F.substring_index("phrase", " ", -2), F.substring_index("phrase", " ", 2)
    longer = phrases.where("k = 3").select("lang", F.explode(F.array(front, back)).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored(frequent, phrases).join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {INSIDE} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = part.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    result = ranked.where(F.col("rank") <= top).join(total, "lang")
    return result.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SCORE = "((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) t(k)),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.k, a, l.f AS l, r.f AS r, {_SCORE} AS score,
           row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY {_SCORE}, c) AS place
    FROM cuts
    JOIN grams l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.w[1:c], ' ')
    JOIN grams r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.w[c + 1:], ' ')),
inner_of AS (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer
    FROM candidates WHERE k = 3),
longest AS (SELECT lang, phrase, max(longer) AS longer FROM inner_of GROUP BY ALL),
ranked AS (
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, score
    FROM scored s LEFT JOIN longest USING (lang, phrase)
    WHERE place = 1 AND (longer IS NULL OR 100 * longer < {INSIDE} * a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
