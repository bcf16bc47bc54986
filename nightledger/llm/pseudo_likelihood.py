"""Documents scored by masked pseudo-likelihood: each word predicted from both sides.

A word's probability, given the two words before and after it, is that of its class times
its share of the class. Classes: the ``FREQUENT`` most frequent words have one each, the
others share ``CLASSES - FREQUENT`` by hash. Words are counted in ``BUCKETS`` hash buckets
over the whole corpus. The class comes from a window network: embeddings of the four
neighbours' classes, a hidden layer, a softmax. A document's score is the sum of the log
probabilities of all its words.

Training: one pass over the corpus counts the words and writes each word's bucket; the next deals
the windows around all words by their neighbours' classes and counts equal ones, which are few
kinds among many windows. In each of ``ROUNDS`` rounds every task trains the current network with
numpy on all its windows: windows with the same neighbours share one forward and backward step, up
to ``SHARED`` of them, each at its full weight, and ``BATCH`` such steps are taken at a time. The
results are averaged, weighted by windows, in a shuffle. The driver holds one network and the
bucket counts, whose sizes don't depend on the corpus.
``SAMPLE`` above 1 trains on one in so many windows instead, for trials.

Defined cases: null and empty texts and texts without a word have 0 words, a sum of 0 and a
null mean; neighbours beyond a text's ends are a class of their own; repeated rows get equal
scores; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage
from .text import Words, blocks, mix, words

BUCKETS = 1 << 16
CLASSES = 64
FREQUENT = 48
SIDE = 2
WIDTH = 16
HIDDEN = 24
SAMPLE = 1
ROUNDS = 3
BATCH = 256
#: Windows with the same neighbours that are taken as one at most; more are split evenly.
SHARED = 8
#: Windows that a task merges, windows sorted at once, and distinct windows trained on at once.
TASK_WINDOWS = 1_000_000
SORTED = 1 << 21
HELD = 1 << 17
RATE = 0.05
SEED = 5


def buckets(w: Words) -> np.ndarray:
    return (w.hash >> np.uint64(48)).astype(np.int64)


def windows(values: np.ndarray, text: np.ndarray, outside: int) -> np.ndarray:
    """Columns: the values SIDE before to SIDE after each place, the own one in the middle."""
    out = np.full((len(values), 2 * SIDE + 1), outside, np.int64)
    for column, step in enumerate(range(-SIDE, SIDE + 1)):
        at = np.arange(len(values)) + step
        inside = (at >= 0) & (at < len(values))
        inside[inside] = text[at[inside]] == text[inside]
        out[inside, column] = values[at[inside]]
    return out


@dataclass
class Network:
    """Parameters; class CLASSES stands for what lies beyond a text's end."""

    embedding: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(share: np.ndarray, seed: int = SEED) -> Network:
        draw = np.random.default_rng(seed)
        return Network(
            draw.normal(0, 0.3, (CLASSES + 1, WIDTH)),
            draw.normal(0, (2 * SIDE * WIDTH) ** -0.5, (2 * SIDE * WIDTH, HIDDEN)),
            np.zeros(HIDDEN),
            draw.normal(0, 0.1, (HIDDEN, CLASSES)),
            np.log(share),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in vars(self).values()])

    def like(self, values: np.ndarray) -> Network:
        parts, at = [], 0
        for x in vars(self).values():
            parts.append(values[at : at + x.size].reshape(x.shape))
            at += x.size
        return Network(*parts)

    def past(self) -> np.ndarray:
        """Squared gradients before the first step."""
        return np.full(len(self.flat()), 1e-6, np.float32)

    def train(
        self, context: np.ndarray, target: np.ndarray, seed: int, past: np.ndarray | None = None, n: np.ndarray | None = None
    ) -> None:
        """One pass in batches, with steps scaled by past gradients (Adagrad), which are updated.

        ``n`` says how often each window occurs, where windows with the same neighbours lie side by side.
        """
        past = self.past() if past is None else past
        value = self.flat().astype(np.float32)
        step = np.zeros_like(value)
        now, to = self.like(value), self.like(step)  # views
        parts, dparts = (n.hidden.reshape(2 * SIDE, WIDTH, HIDDEN) for n in (now, to))
        if not len(target):
            return
        fresh = np.ones(len(target), bool)
        if n is not None:
            fresh[1:] = (context[1:] != context[:-1]).any(axis=1)
        group, n = np.cumsum(fresh) - 1, np.ones(len(target)) if n is None else n
        first, size, total = np.flatnonzero(fresh), np.bincount(group), np.bincount(group, n)
        pieces = np.ceil(total / SHARED).astype(np.int64)
        share, weight = (n / pieces[group]).astype(np.float32), (total / pieces).astype(np.float32)
        order = np.random.default_rng(seed).permutation(np.repeat(np.arange(len(first)), pieces))
        # places of the windows of each piece, piece after piece
        ends = np.append(0, np.cumsum(size[order]))
        at = np.arange(ends[-1]) + np.repeat(first[order] - ends[:-1], size[order])
        target, share = target[at], share[at]
        # every neighbour is one of few classes: its products are looked up, and summed by class
        context = context[first] + np.arange(2 * SIDE) * (CLASSES + 1)
        slot = np.arange(BATCH)[:, None]
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            own = slice(ends[lo], ends[lo + len(rows)])
            c, k, whole = context[rows], np.repeat(slot[: len(rows), 0], size[rows]), weight[rows].sum()
            tables = (now.embedding @ parts).reshape(-1, HIDDEN)
            h = np.tanh(sum(tables[c[:, i]] for i in range(2 * SIDE)) + now.hidden_bias)
            z = h @ now.out
            z += now.out_bias
            z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z *= (weight[rows] / (whole * z.sum(axis=1)))[:, None]
            z[k, target[own]] -= share[own] / whole
            dh = (z @ now.out.T) * (1 - h * h)
            seen = np.zeros((len(rows), len(tables)), np.float32)
            seen[slot[: len(rows)], c] = 1
            by_class = (seen.T @ dh).reshape(2 * SIDE, CLASSES + 1, HIDDEN)
            to.embedding[:] = (by_class @ parts.transpose(0, 2, 1)).sum(axis=0)
            dparts[:] = now.embedding.T @ by_class
            to.hidden_bias[:], to.out[:], to.out_bias[:] = dh.sum(axis=0), h.T @ z, z.sum(axis=0)
            past += step * step
            value -= np.float32(RATE) * step / np.sqrt(past)
        for held, new in zip(vars(self).values(), vars(now).values(), strict=True):
            held[:] = new


@dataclass
class Model:
    network: Network
    of_bucket: np.ndarray
    #: Log share of each bucket in its class.
    within: np.ndarray

    def __post_init__(self):
        parts = self.network.hidden.reshape(2 * SIDE, WIDTH, HIDDEN)
        self.tables = [(self.network.embedding @ p).astype(np.float32) for p in parts]
        self.tables[0] = self.tables[0] + self.network.hidden_bias.astype(np.float32)

    def log_probabilities(self, w: Words) -> np.ndarray:
        """One value for each word."""
        own = buckets(w)
        classes = windows(self.of_bucket[own], w.text, CLASSES)
        out = np.empty(len(own))
        weight, bias = self.network.out.astype(np.float32), self.network.out_bias.astype(np.float32)
        neighbours = [i for i in range(2 * SIDE + 1) if i != SIDE]
        for lo in range(0, len(own), 1 << 14):
            c = classes[lo : lo + (1 << 14)]
            h = sum(t[c[:, i]] for t, i in zip(self.tables, neighbours, strict=True))
            z = np.tanh(h) @ weight + bias
            z -= z.max(axis=1, keepdims=True)
            total = np.log(np.exp(z).sum(axis=1, dtype=np.float64))
            out[lo : lo + len(c)] = z[np.arange(len(c)), c[:, SIDE]] - total
        return out + self.within[own]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and sum of log probabilities of each text."""
        w = words(texts)
        return w.count, np.bincount(w.text, self.log_probabilities(w), len(texts)) if len(w.hash) else np.zeros(len(texts))


def gather(docs: DataFrame) -> DataFrame:
    """Bucket counts of each task, and the buckets of each block's words, written.

    ``windows`` holds the buckets, from which ``near`` makes the windows, and ``sizes`` how many
    words each text has.
    """

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        kind = pa.schema([("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("windows", pa.binary()), ("sizes", pa.list_(pa.int32()))])
        for batch in batches:
            for _, texts in blocks(batch):
                w = words(texts)
                if not len(w.hash):
                    continue
                own = buckets(w)
                total += np.bincount(own, minlength=BUCKETS)
                row = {"bucket": None, "n": None, "windows": own.astype("<u2").tobytes(), "sizes": w.count}
                yield pa.RecordBatch.from_pylist([row], kind)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32)]).cast(kind[0].type), pa.array([total[at]]), pa.array([None], pa.binary()), pa.array([None], kind[3].type)], schema=kind)

    return stage(docs.select("text").mapInArrow(run, "bucket array<int>, n array<long>, windows binary, sizes array<int>"))


def near(held: bytes, sizes: np.ndarray) -> np.ndarray:
    """The windows of a block's words, as buckets."""
    found = windows(np.frombuffer(held, "<u2").astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), BUCKETS)
    if SAMPLE > 1:
        found = found[mix(mix(found.astype(np.uint64)).sum(axis=1, dtype=np.uint64)) % np.uint64(SAMPLE) == 0]
    return found


def packed(found: np.ndarray) -> np.ndarray:
    """Windows of classes as numbers, which sort by the neighbours first."""
    code = np.zeros(len(found), np.uint32)
    for i in [i for i in range(2 * SIDE + 1) if i != SIDE] + [SIDE]:
        code = code * np.uint32(CLASSES + 1) + found[:, i].astype(np.uint32)
    return code


def unpacked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours and the word in the middle."""
    code, target = np.divmod(code.astype(np.int64), CLASSES + 1)
    return np.stack([code // (CLASSES + 1) ** i % (CLASSES + 1) for i in reversed(range(2 * SIDE))], axis=1), target


def distinct(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else order
    return code[order][first], np.add.reduceat(n[order], first) if len(code) else n


def counted(gathered: DataFrame, classes, tasks: int) -> DataFrame:
    """(codes, n): the distinct windows of all blocks and how often each occurs, dealt by neighbours and written.

    ``classes`` is the broadcast class of each bucket. A task sorts ``SORTED`` windows at a time; rows
    hold about ``HELD`` distinct windows, chosen by a hash of their neighbours.
    """

    def dealt_to(code: np.ndarray, parts: int, shift: int = 0) -> np.ndarray:
        return ((mix(code.astype(np.uint64) // np.uint64(CLASSES + 1)) >> np.uint64(shift)) % np.uint64(parts)).astype(np.int32)

    def cut(part: np.ndarray, code: np.ndarray, n: np.ndarray):
        order = np.argsort(part, kind="stable")
        part, code, n = part[order], code[order].astype("<u4"), n[order].astype("<u8")
        at = np.flatnonzero(np.append(True, np.diff(part) != 0))
        for lo, hi in zip(at, np.append(at[1:], len(part)), strict=True):
            yield int(part[lo]), code[lo:hi].tobytes(), n[lo:hi].tobytes()

    kind = pa.schema([("part", pa.int32()), ("codes", pa.binary()), ("n", pa.binary())])

    def rows(held: list[np.ndarray]):
        code, n = np.unique(np.concatenate(held), return_counts=True)
        for part, codes, counts in cut(dealt_to(code, tasks), code, n):
            yield pa.RecordBatch.from_pylist([{"part": part, "codes": codes, "n": counts}], kind)

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(len(batch)):
                found = packed(classes.value[near(batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy())])
                held.append(found)
                size += len(found)
                if size >= SORTED:
                    yield from rows(held)
                    held, size = [], 0
        if size:
            yield from rows(held)

    def merge(batches):
        codes, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        for batch in batches:
            codes += [np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)]
            n += [np.frombuffer(x.as_py(), "<u8") for x in batch.column(2)]
        code, number = distinct(np.concatenate(codes), np.concatenate(n))
        if len(code):
            for _, codes, counts in cut(dealt_to(code, -(-len(code) // HELD), 32), code, number):
                yield pa.RecordBatch.from_pylist([{"codes": codes, "n": counts}], pa.schema([kind.field("codes"), kind.field("n")]))

    dealt = gathered.where("windows is not null").select("windows", "sizes").mapInArrow(deal, "part int, codes binary, n binary")
    return stage(dealt.repartition(tasks, "part").mapInArrow(merge, "codes binary, n binary"))


def class_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each bucket, log share in its class, and share of each class (add-one)."""
    frequent = np.argsort(-counts, kind="stable")[:FREQUENT]
    of = FREQUENT + (mix(np.arange(BUCKETS, dtype=np.uint64)) % np.uint64(CLASSES - FREQUENT)).astype(np.int64)
    of[frequent] = np.arange(FREQUENT)
    smooth = counts + 1.0
    total = np.bincount(of, smooth, CLASSES)
    return of, np.log(smooth / total[of]), total / total.sum()


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    spark = docs.sparkSession
    gathered = gather(docs)
    pairs = gathered.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "n")).alias("x"))
    counts = np.zeros(BUCKETS, np.int64)
    for r in pairs.groupBy("x.bucket").agg(F.sum("x.n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    of, within, share = class_of(counts)
    network = Network.start(share)
    tasks = max(1, -(-int(counts.sum()) // TASK_WINDOWS))
    held = counted(gathered, spark.sparkContext.broadcast(np.append(of, CLASSES)), tasks) if rounds else gathered
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(network)

        def run(batches, number=number, shared=shared):
            own = shared.value.like(shared.value.flat().copy())
            seen, past = 0, own.past()
            for batch in batches:
                for i in range(len(batch)):
                    n = np.frombuffer(batch.column(1)[i].as_py(), "<u8").astype(np.int64)
                    own.train(*unpacked(np.frombuffer(batch.column(0)[i].as_py(), "<u4")), SEED + number, past, n)
                    seen += int(n.sum())
            if seen:
                values = own.flat()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * seen), pa.array(np.full(len(values), seen))],
                    ["place", "value", "n"],
                )

        rows = held.mapInArrow(run, "place int, value double, n long")
        means = rows.groupBy("place").agg((F.sum("value") / F.sum("n")).alias("value")).collect()
        if not means:
            break
        values = np.zeros(len(means))
        for r in means:
            values[r["place"]] = r["value"]
        network = network.like(values)
    return Model(network, of, within)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, words, log_likelihood, mean) of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("words bigint, log_likelihood double")
    def scored(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [shared.value.scores(texts) for _, texts in blocks(batch)]
        arrays = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1)]
        return pa.StructArray.from_arrays([pa.array(arrays[0].astype(np.int64)), pa.array(arrays[1])], ["words", "log_likelihood"])

    rows = docs.select("doc_id", scored("text").alias("s")).select("doc_id", "s.*")
    return rows.withColumn("mean", F.when(F.col("words") > 0, F.col("log_likelihood") / F.col("words")))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs))
