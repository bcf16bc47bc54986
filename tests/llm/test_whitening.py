"""Whitened values against fractions and numpy, the refinement on close eigenvalues, odd vectors."""

from fractions import Fraction

import numpy as np

from nightledger.llm import whitening as W

from . import samples

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<double>, x int, d string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k=4):
    """id -> (n, deviation, whitened by component) and shares, from exact fractions and a float64 solver."""
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    y = [[Fraction(v[j]) - Fraction(sums[j], n) for j in range(d)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        centred = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums)])
        out[i] = (n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), centred @ vectors[:, :k] / np.sqrt(values[:k]))
    return out, values[:k] / np.trace(cov)


def random_rows(n, d, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(1, 0.2, d) + rng.standard_normal(d)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_against_fractions(spark):
    rows = random_rows(150, 7)
    rows += [(1000 + i, v) for i, v in rows[:60]] + [(2000 + i, rows[0][1]) for i in range(40)]
    got = W.whiten(frame(spark, rows)).collect()
    want, shares = plain(rows)
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        n, deviation, values = want[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        c = r["component"] - 1
        sign = signs.setdefault(c, np.sign(r["whitened"]) * np.sign(values[c]))
        assert abs(r["whitened"] * sign - values[c]) < 1e-10
        assert abs(r["explained"] - shares[c]) < 1e-12
        assert r["identity_error"] < 1e-10


def test_refinement_reaches_what_float32_cannot():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to the last place
        q = q @ (3 * np.eye(40, dtype=q.dtype) - q.T @ q) / 2
    # apart, close, closer than float32 tells, closer than float64 tells, and equal
    true = np.concatenate([np.linspace(9, 5, 20), [3, 3 - 1e-9, 3 - 2e-9, 2, 2 - 1e-13, 2 - 3e-13], np.full(4, 1.5), np.linspace(1, 1e-6, 10)]).astype(np.longdouble)
    a = (q * true) @ q.T
    a = (a + a.T) / 2
    values, x = W.eigen(a)
    assert np.abs(values - np.sort(true)[::-1]).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-17
    assert np.abs(a @ x - x * values).max() < 1e-17
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    assert np.abs(rough.T @ a @ rough - np.diag(np.diag(rough.T @ a @ rough))).max() > 1e-9
    order = np.argsort(-true, kind="stable")
    for i in [*range(26), *range(30, 40)]:  # the single ones; an error is the rounding over the gap
        gap = np.sort(np.abs(true - true[order[i]]))[1]
        assert 1 - abs(x[:, i] @ q[:, order[i]]) < 1e-17 + (1e-17 / gap) ** 2


def test_co_moments_are_exact_beyond_float64():
    rng = np.random.default_rng(2)
    for big in (100, 2**30, 2**62):
        x = rng.integers(-big, big, (50, 3))
        c = rng.integers(-big, big, 3)
        total, product = W.co_moments(x, c)
        y = x.astype(object) - c.astype(object)
        assert total.tolist() == y.sum(axis=0).tolist() and product.tolist() == (y.T @ y).tolist()
        back = 0
        for k, part in W._limbs(product[0]):
            back = back + (np.array(part, object) << (W.LIMB * k))
        assert back.tolist() == product[0].tolist()


def test_deviation_at_the_edge_of_a_long():
    model = {"n": 10**9, "sums": np.array([0, 0], object)}
    x = np.array([[3, 0], [3, 1], [4, 0], [-3, 0]])
    assert W.deviations(x, model) == [9 * 10**18, None, None, 9 * 10**18]


def test_odd_vectors(spark):
    good = [(i, v) for i, v in random_rows(30, 3)]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [NAN, 1.0, 1.0]), (94, [INF, 0.0, 0.0]), (None, good[0][1])]
    short = [(200, [0.5, 0.5]), (201, [0.5, 0.5])]
    got = W.whiten(frame(spark, good + odd + short)).collect()
    ids = [r["vec_id"] for r in got]
    assert sorted(set(ids) - {None}) == [*range(30), 200, 201]
    assert ids.count(None) == 3 and ids.count(0) == 3 and ids.count(200) == 2
    assert {r["n"] for r in got if r["vec_id"] == 0} == {30}
    for r in got:
        if r["vec_id"] in (200, 201):  # one distinct vector has no variance
            assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None)


def test_huge_entries_and_low_rank(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 1.0]), (2, [1e300, 1.0])]
    got = {(r["vec_id"], r["component"]): r for r in W.whiten(frame(spark, rows)).collect()}
    assert got[0, 1]["n"] == 2 and got[0, 1]["deviation"] is None
    assert abs(abs(got[0, 1]["whitened"]) - 1) < 1e-12 and got[0, 1]["whitened"] == got[2, 1]["whitened"]
    assert got[0, 2]["whitened"] is None and got[0, 1]["identity_error"] < 1e-9


def test_empty_table_and_query(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whiten(empty).collect() == []
    from nightledger.llm.registry import queries

    got = queries()["op11_whitening"](spark, samples.SF_DIR).collect()
    table = spark.read.parquet(f"{samples.SF_DIR}/embeddings.parquet").collect()
    want, shares = plain([(r["vec_id"], [float(c) for c in r["embedding"]]) for r in table])
    assert len(got) == 4 * len(table)
    assert all(r["deviation"] == want[r["vec_id"]][1] and abs(abs(r["whitened"]) - abs(want[r["vec_id"]][2][r["component"] - 1])) < 1e-9 for r in got)
