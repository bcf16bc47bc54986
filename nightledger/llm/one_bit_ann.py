"""Nearest neighbours by randomly rotated one-bit codes, with error bounds for reranking.

Each vector is scaled to length one, turned by a random rotation and kept as the signs of
its coordinates, with one scalar: the inner product of the turned vector with its code. The
code's inner product with a turned query, divided by that scalar, estimates the cosine; the
error is about sqrt((1 - s*s) / (s*s) / (d - 1)) in standard deviations, and EPSILON of
them bound it. Of each chunk, the vectors with the best estimates are compared exactly;
then every vector whose bound reaches the fifth best exact score so far is.

Queries go to the tasks in blocks of about ``QUERIES`` or ``NUMBERS`` components, one
block at a time: the driver holds one block, and what the tasks found (the best few of their
rows for each query) is written before the next. Scores are cosines of the original vectors
in double precision, summed in the order of coordinates. Vectors are first divided by a power
of two near their largest component, which changes no cosine and keeps squares in range.

Vectors are compared with those of their own length. Beyond ``TURNED`` components, parts of
that many, dealt at random, are turned one by one.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do null vec_ids; rows that share a query's vec_id are not among its candidates;
equal query rows count once; a repeated candidate row may be found twice; with fewer
candidates of its length than asked for, a query gets them all; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import cut, root, stage

NEAREST = 5
EPSILON = 3.0
SEED = 2
QUERIES = 2048
#: Components of the queries of a block.
NUMBERS = 1 << 23
CHUNK = 1024
PAIRS = 4096
#: Components that are turned together at most.
TURNED = 2048

FOUND = "number long, query_id long, vec_id long, score double"


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def turn(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The rows turned at random, all of a length alike."""
    d = x.shape[1]
    if d <= TURNED:
        return x @ rotation(d, seed)
    dealt = np.random.default_rng([seed, d]).permutation(d)
    return np.hstack([x[:, p] @ rotation(len(p), seed) for p in np.array_split(dealt, -(-d // TURNED))])


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two, so that its largest component is from 1/2 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))


def _by_length(batch: pa.RecordBatch):
    """(d, rows of vectors of that length, at most ``CHUNK``) of a batch whose second column holds vectors."""
    sizes = pc.list_value_length(batch.column(1)).to_numpy()
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for lo in range(0, len(rows), CHUNK):
            yield d, batch.take(pa.array(rows[lo : lo + CHUNK]))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(x, x))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, added in the order of coordinates."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def _pair_dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Row i of x with row j of y, added in the order of coordinates; a coordinate and ``PAIRS`` fit a cache."""
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    total = np.zeros(len(i))
    for lo in range(0, len(i), PAIRS):
        own = slice(lo, lo + PAIRS)
        for a, b in zip(xt, yt, strict=True):
            total[own] += a[i[own]] * b[j[own]]
    return total


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite & nonzero, F.lit(False)))


def index(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(vec_id, vector, code, scalar): every usable row, written."""

    def encode(batches):
        for whole in batches:
            for d, batch in _by_length(whole):
                x = _matrix(batch.column(1), d)
                turned = turn(x / norms(x)[:, None], seed)
                code = np.packbits(turned > 0, axis=1)
                scalar = np.abs(turned).sum(axis=1) / np.sqrt(d)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, codes, pa.array(scalar)], ["vec_id", "vector", "code", "scalar"])

    return stage(rows.mapInArrow(encode, "vec_id long, vector array<double>, code binary, scalar double"))


def _merge(ids, scores, new_ids, new_scores, k: int):
    """The k best of two lists for each query: by score, then smaller id; -inf marks none."""
    ids, scores = np.hstack([ids, new_ids]), np.hstack([scores, new_scores])
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


class Block:
    """Queries of one length, and the best that a task has found for them."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, epsilon: float, seed: int):
        self.numbers, self.ids, self.q = numbers, ids, scaled(vectors)
        self.norm = norms(self.q)
        self.turned = turn(self.q / self.norm[:, None], seed).astype(np.float32).T
        self.k, self.epsilon = k, epsilon
        n = len(ids)
        self.found = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

    def search(self, batch: pa.RecordBatch) -> None:
        n, d, k = *self.q.shape, self.k
        v_ids = batch.column(0).to_numpy()
        x = _matrix(batch.column(1), d)
        x_norm = norms(x)
        code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
        s = batch.column(3).to_numpy()[:, None]
        signs = np.unpackbits(code, axis=1)[:, :d].astype(np.float32) * 2 - 1
        estimate = (signs @ self.turned) / np.float32(np.sqrt(d)) / s
        bound = self.epsilon * np.sqrt(np.maximum(1 - s * s, 0) / (s * s) / max(d - 1, 1))
        estimate[v_ids[:, None] == self.ids] = -np.inf

        def exact(i, j):
            return _pair_dots(self.q, j, x, i) / (self.norm[j] * x_norm[i])

        best = min(2 * k, len(batch))
        first = np.argpartition(-estimate, best - 1, axis=0)[:best].T
        i, j = first.ravel(), np.repeat(np.arange(n), best)
        own = np.isinf(estimate[i, j])
        scores = np.where(own, -np.inf, exact(i, j)).reshape(n, best)
        self.found = _merge(*self.found, v_ids[first], scores, k)
        estimate[i, j] = -np.inf
        # what may still reach the k-th best
        i, j = np.nonzero(estimate + bound >= self.found[1][:, -1])
        real = ~np.isinf(estimate[i, j])
        i, j = i[real], j[real]
        if len(i):
            order = np.argsort(j, kind="stable")
            i, j = i[order], j[order]
            count = np.bincount(j, minlength=n)
            place = np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count)
            more_ids = np.full((n, count.max()), np.iinfo(np.int64).max)
            more = np.full((n, count.max()), -np.inf)
            more_ids[j, place], more[j, place] = v_ids[i], exact(i, j)
            self.found = _merge(*self.found, more_ids, more, k)

    def rows(self) -> pa.RecordBatch:
        ids, scores = self.found
        j, r = np.nonzero(~np.isinf(scores))
        columns = [self.numbers[j], self.ids[j], ids[j, r], scores[j, r]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "query_id", "vec_id", "score"])


def _search(indexed: DataFrame, queries: list, k: int, epsilon: float, seed: int, path: str) -> None:
    """Adds what a block of queries (number, vec_id, vector) finds to the table at ``path``."""
    lengths: dict[int, list] = {}
    for query in queries:
        lengths.setdefault(len(query["vector"]), []).append(query)
    parts = {d: [np.array(c) for c in zip(*held, strict=True)] for d, held in lengths.items()}
    shared = indexed.sparkSession.sparkContext.broadcast(parts)

    def search(batches):
        found = {d: Block(*held, k, epsilon, seed) for d, held in shared.value.items()}
        for whole in batches:
            for d, batch in _by_length(whole):
                if d in found:
                    found[d].search(batch)
        for block in found.values():
            yield block.rows()

    indexed.mapInArrow(search, FOUND).write.mode("append").parquet(path)
    shared.destroy()


def nearest(
    vectors: DataFrame, every: int, k: int = NEAREST, epsilon: float = EPSILON, seed: int = SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each row with vec_id divisible by ``every``."""
    spark = vectors.sparkSession
    indexed = index(usable(vectors), seed)
    asked = cut(indexed.where(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct().withColumn("number", F.monotonically_increasing_id()))
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    blocks = -(-5 * max(n * NUMBERS, numbers * QUERIES) // (4 * QUERIES * NUMBERS))
    path = f"{root(spark).rstrip('/')}/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND).write.parquet(path)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("number", "vec_id", "vector").collect()
        if block:
            _search(indexed, sorted(block), k, epsilon, seed, path)
    order = Window.partitionBy("number", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50)


def _ordered_sum(x: str, y: str) -> str:
    return f"list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * {y}[i])), lambda s, v: s + v)"


#: The power of two beside the largest component; logarithms may round up to one that no double holds.
_POWER = "pow(2.0, least(1023, greatest(-1022, floor(log2(list_max(list_transform(v, lambda x: abs(x))))))))"

ORACLE_SQL = f"""
WITH given AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
powers AS (SELECT vec_id, v, {_POWER} AS p FROM given),
scaled AS (SELECT vec_id, list_transform(v, lambda x: x / p) AS v FROM powers),
usable AS (SELECT vec_id, v, sqrt({_ordered_sum("v", "v")}) AS norm FROM scaled),
asked AS (SELECT DISTINCT vec_id, v, norm FROM usable WHERE vec_id % 50 = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, {_ordered_sum("q.v", "c.v")} / (q.norm * c.norm) AS score
    FROM asked q JOIN usable c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id),
ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}
"""
