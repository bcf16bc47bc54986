"""Whitening: a distributed covariance, float32 eigenvectors, and their refinement.

Entries c become whole numbers x = floor(256 * c). Each distinct x vector counts once (the fit
list). Its sums and its co-moments about the rounded mean are added up exactly: tasks multiply
blocks as float64 where every sum stays below 2**53, otherwise as Python integers, and send
matrices in limbs of 40 bits that Spark adds. The driver gets one matrix as wide as a vector.

Its eigenvectors come from a float32 solver and are corrected by the iteration of Ogita and
Aishima, which is four matrix products a step, in ``np.longdouble``. Eigenvalues closer than
the step can tell apart form a cluster: the matrix shifted by the cluster's mean and seen in
its vectors is solved for itself, and the vectors turn by the result.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are left
out; repeated rows stay rows, and count once for the fit; vectors of each length are whitened
for themselves; entries beyond a long become the nearest long; a deviation beyond a long is
null; a component without variance (below ``FLAT`` of the largest) has no whitened value and
takes no part in identity_error; without any variance explained and identity_error are null;
of equal eigenvalues any orthogonal vectors; signs make a component's largest entry positive;
an empty table gives no rows; only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage

SCALE = 256
COMPONENTS = 4
#: Eigenvalues below this share of the largest count as zero.
FLAT = 1e-15
#: Rows multiplied at once; bits of a limb.
BLOCK = 8192
LIMB = 40
STEPS = 20


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that remain."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c * SCALE).cast("long"))
    kept = vectors.where(F.coalesce(finite & (F.size(vector) > 0), F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _by_length(column: pa.Array):
    """Vector length, row numbers and matrix, for each length in a batch, in blocks of rows."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        for lo in range(0, len(rows), BLOCK):
            at = rows[lo : lo + BLOCK]
            yield int(d), at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def co_moments(x: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and products of the rows of x about whole-numbered center, as Python integers."""
    bound = int(np.abs(x.astype(np.float64)).max()) + int(np.abs(center.astype(np.float64)).max()) + 2
    if len(x) * bound * bound < 1 << 53:
        y = (x - center).astype(np.float64)
        total, product = y.sum(axis=0).astype(np.int64), (y.T @ y).astype(np.int64)
        return total.astype(object), product.astype(object)
    y = x.astype(object) - center.astype(object)
    return y.sum(axis=0), y.T @ y


def _limbs(values: np.ndarray):
    """Numbers of LIMB bits that make up the values, the last with the sign."""
    k = 0
    while any(abs(v) >> LIMB for v in values):
        yield k, [v & ((1 << LIMB) - 1) for v in values]
        values, k = values >> LIMB, k + 1
    yield k, list(values)


def _exact_sums(fit: DataFrame, centers: dict[int, np.ndarray] | None) -> dict[int, dict[int, np.ndarray]]:
    """For each length: line -1 has the number of vectors, line d their sums, lines below d their
    products about the centers (only if there are centers)."""
    shared = fit.sparkSession.sparkContext.broadcast(centers)

    def partial(batches):
        held: dict[int, list] = {}
        known = shared.value
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                if known is None:
                    n, total, product = held.get(d, (0, 0, 0))
                    held[d] = (n + len(x), total + co_moments(x, np.zeros(d, np.int64))[0], product)
                else:
                    more, square = co_moments(x, known[d])
                    n, total, product = held.get(d, (0, 0, 0))
                    held[d] = (n + len(x), total + more, product + square)
        for d, (n, total, product) in held.items():
            lines = [(-1, np.array([n], object)), (d, total)]
            lines += enumerate(product) if known is not None else []
            out = [(d, i, k, part) for i, line in lines for k, part in _limbs(line)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[j] for r in out], pa.int32()) for j in range(3)), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                ["d", "line", "limb", "part"],
            )

    parts = fit.mapInArrow(partial, "d int, line int, limb int, part array<long>")
    added = parts.select("d", "line", "limb", F.posexplode("part").alias("at", "v")).groupBy("d", "line", "limb", "at").agg(F.sum("v").alias("v"))
    lines = added.groupBy("d", "line", "limb").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("part"))
    result: dict[int, dict[int, np.ndarray]] = {}
    for r in lines.collect():
        line = np.array([int(p["v"]) << (LIMB * r["limb"]) for p in r["part"]], object)
        of = result.setdefault(r["d"], {})
        of[r["line"]] = of.get(r["line"], 0) + line
    return result


def _extended(values: np.ndarray) -> np.ndarray:
    """Python integers as longdoubles, right to their last place."""
    high = values.astype(np.float64)
    low = (values - np.vectorize(int, otypes=[object])(high)).astype(np.float64)
    return high.astype(np.longdouble) + low.astype(np.longdouble)


def _clusters(values: np.ndarray, delta) -> list[np.ndarray]:
    """Index sets of two or more sorted values whose neighbours differ by no more than delta."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(np.abs(np.diff(values[order])) > delta) + 1
    return [s for s in np.split(order, cuts) if len(s) > 1]


def _state(a: np.ndarray, x: np.ndarray):
    """Residuals of orthogonality, the matrix in the vectors, its diagonal, what can be told apart, and the least that could."""
    r = np.eye(x.shape[1], dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding counts as a turn between close eigenvalues
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = np.sqrt((a * a).sum())
    delta = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
    return r, s, values, delta, 64 * len(a) * np.finfo(a.dtype).eps * norm


def _orthogonal(x: np.ndarray) -> np.ndarray:
    """Nearly orthogonal columns, one Newton step closer."""
    return x @ (3 * np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2


def _solved_within(a: np.ndarray, x: np.ndarray, values: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The vectors of cluster j, turned to the eigenvectors of the shifted matrix that they see."""
    own = x[:, j]
    small = own.T @ (a @ own) - np.mean(values[j]) * (own.T @ own)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if not size > 0:
        return own
    return own @ _orthogonal(np.linalg.eigh((small / size).astype(np.float64))[1].astype(a.dtype))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric longdouble matrix."""
    d, scale = len(a), np.abs(a).max()
    if not scale > 0:
        return np.zeros(d, a.dtype), np.eye(d, dtype=a.dtype)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    for _ in range(STEPS):
        r, s, values, delta, least = _state(a, x)
        if delta <= least:
            break
        groups = _clusters(values, max(delta, least))
        if groups:
            for j in groups:
                x[:, j] = _solved_within(a, x, values, j)
            r, s, values, delta, least = _state(a, x)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > max(delta, least)
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x / np.sqrt((x * x).sum(axis=0))
    values = np.diag(x.T @ (a @ x)) * scale
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    top = x[np.abs(x).argmax(axis=0), np.arange(d)]
    return values, x * np.sign(top)


def fitted(fit: DataFrame, k: int) -> dict[int, dict]:
    """For each vector length: n, sums, the first k axes over the root of their eigenvalues, shares."""
    first = _exact_sums(fit, None)
    n = {d: int(lines[-1][0]) for d, lines in first.items()}
    # halves are rounded down: the rest is taken off exactly below
    centers = {d: np.array([int(t) // n[d] for t in lines[d]], np.int64) for d, lines in first.items()}
    models = {}
    for d, lines in _exact_sums(fit, centers).items():
        rest = lines[d]
        square = n[d] * np.array([lines[i] for i in range(d)], object) - np.outer(rest, rest)
        covariance = _extended(square) / _extended(np.array([n[d] * n[d]], object))[0]
        values, vectors = eigen(covariance)
        trace = np.trace(covariance)
        keep = min(k, d)
        solid = values[:keep] > FLAT * values[0] if values[0] > 0 else np.zeros(keep, bool)
        root = np.sqrt(np.where(solid, values[:keep], 1))
        models[d] = {
            "n": n[d],
            "sums": first[d][d],
            "axes": (vectors[:, :keep] / root).astype(np.float64),
            "solid": solid,
            "explained": [float(v / trace) if trace > 0 else None for v in values[:keep]],
        }
    return models


def projected(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened values of whole-number rows."""
    n, sums = model["n"], model["sums"]
    mean = [divmod(int(s), n) for s in sums]
    whole = np.array([q for q, _ in mean], np.int64)
    part = np.array([r / n for _, r in mean])
    return ((x.astype(np.float64) - whole) - part) @ model["axes"]


def deviations(x: np.ndarray, model: dict) -> list[int | None]:
    """The sum of (n * x - S)**2 for each row; None beyond a long."""
    n, sums = model["n"], model["sums"]
    limit = 1 << 63
    largest = n * (int(np.abs(x.astype(np.float64)).max()) + 1) + max(abs(int(s)) for s in sums)
    if largest < 1 << 62:
        y = x * np.int64(n) - sums.astype(np.int64)
        about = (y.astype(np.float64) ** 2).sum(axis=1)
        total = (y * y).sum(axis=1)  # right modulo 2**64, so right where it fits
        if (about < 0.99 * limit).all():
            return total.tolist()
    out = []
    for row in x.astype(object):
        total = sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True))
        out.append(total if total < limit else None)
    return out


def _identity_errors(fit: DataFrame, models: dict[int, dict]) -> dict[int, float | None]:
    """Largest entry of the whitened fit list's covariance minus the identity, by length."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def partial(batches):
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                w = projected(x, shared.value[d])
                mean = w.mean(axis=0)
                within = (w - mean).T @ (w - mean)
                sums = np.concatenate([[len(w)], len(w) * mean, (within + len(w) * np.outer(mean, mean)).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([sums.tolist()])], ["d", "part"])

    parts = fit.mapInArrow(partial, "d int, part array<double>").select("d", F.posexplode("part").alias("at", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("d", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["d"], {})[r["at"]] = r["v"]
    errors: dict[int, float | None] = {}
    for d, sums in found.items():
        solid = models[d]["solid"]
        k = len(solid)
        n, mean = sums[0], np.array([sums[1 + i] for i in range(k)]) / sums[0]
        covariance = np.array([sums[1 + k + i] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean)
        off = np.abs(covariance - np.eye(k))[solid][:, solid]
        errors[d] = float(off.max()) if off.size else None
    return errors


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component up to k."""
    rows = whole_numbers(vectors)
    fit = stage(rows.select("x").distinct())
    models = fitted(fit, k)
    errors = _identity_errors(fit, models) if models else {}
    shared = vectors.sparkSession.sparkContext.broadcast((models, errors))

    def project(batches):
        models, errors = shared.value
        for batch in batches:
            ids = batch.column(0)
            for d, at, x in _by_length(batch.column(1)):
                model = models[d]
                solid, n = model["solid"], len(at)
                values = projected(x, model)
                times = len(solid)
                empty = np.tile(~solid, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(at, times))),
                        pa.array(np.tile(np.arange(1, times + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * times, model["n"], np.int64)),
                        pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(n), times))),
                        pa.array(values.ravel(), mask=empty),
                        pa.array(model["explained"] * n, pa.float64()),
                        pa.array([errors[d]] * (n * times), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(
        project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
