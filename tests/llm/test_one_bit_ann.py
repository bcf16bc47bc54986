"""Neighbours against brute force, the error bound, odd vectors."""

import duckdb
import numpy as np

from nightledger.llm import one_bit_ann as A

from . import samples

INF, NAN = float("inf"), float("nan")


def vectors(n, d, seed=1):
    return np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)


def plain_nearest(rows, every, k):
    """(query, rank, id, score) by all cosines; rows of usable vectors."""
    out = []
    for q, v in rows:
        if q % every:
            continue
        scored = sorted((-float(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w))), i) for i, w in rows if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def found(frame, **kw):
    return sorted(tuple(r) for r in A.nearest(frame, **kw).collect())


def test_recall_on_random_vectors(spark):
    rows = [(i, v.astype(float)) for i, v in enumerate(vectors(3000, 48))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>").repartition(6)
    got, want = found(frame, every=30), plain_nearest(rows, 30, 5)
    assert len(got) == len(want)
    hit = {r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}
    assert len(hit) >= 0.98 * len(want)
    scores = {(q, i): s for q, _, i, s in want}
    for q, _, i, s in got:
        assert abs(s - scores.get((q, i), s)) < 1e-12


def test_estimates_keep_to_the_bound():
    x = vectors(500, 64).astype(float)
    x /= A.norms(x)[:, None]
    turned = x @ A.rotation(64)
    assert np.allclose(turned @ turned.T, x @ x.T)
    s = np.abs(turned).sum(axis=1) / 8
    estimate = (np.where(turned > 0, 1, -1) / 8) @ turned[:50].T / s[:, None]
    error = np.abs(estimate - x @ x[:50].T) * np.sqrt(63) / np.sqrt((1 - s * s) / (s * s))[:, None]
    assert (error[50:] < A.EPSILON).mean() > 0.99


def test_odd_vectors(spark):
    good = {0: [1.0, 0.0], 1: [2.0, 0.0], 2: [1.0, 1.0], 50: [0.0, 1.0], 51: [3.0, 0.0], 52: [-1.0, 0.0]}
    rows = [*good.items(), (51, [3.0, 0.0]), (60, None), (61, [0.0, 0.0]), (62, [NAN, 1.0]), (63, [INF, 1.0])]
    rows += [(64, [1.0, None]), (65, [1.0]), (66, []), (None, [1.0, 0.0]), (100, [0.0, -0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", A.F.lit("x"))
    got = found(frame, every=50)
    # ties go to the smaller id, and a repeated row is found twice
    assert [(q, r, i) for q, r, i, _ in got if q == 0] == [(0, 1, 1), (0, 2, 51), (0, 3, 51), (0, 4, 2), (0, 5, 50)]
    assert [(r, i) for q, r, i, _ in got if q == 50][:3] == [(1, 2), (2, 0), (3, 1)]
    few = spark.createDataFrame(rows[:2], "vec_id long, embedding array<float>")
    assert [r[:3] for r in found(few, every=50)] == [(0, 1, 1)]
    assert found(frame.where("vec_id < 0"), every=50) == []
    assert found(frame.where("vec_id = 1"), every=50) == []


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    return sorted(con.execute(A.ORACLE_SQL).fetchall())


def test_very_large_and_small_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1.0]), (2, [1e200, 0.0]), (3, [1e-200, 0.0]), (4, [5e-324, 0.0])]
    rows += [(50, [0.0, 1.7e308]), (51, [0.0, -5e-324]), (52, [1.7e308, 1.7e308])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50)
    assert got == by_sql(rows)
    assert [(r, i, s) for q, r, i, s in got if q == 0][:4] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (4, 4, 1.0)]
    assert [(r, i) for q, r, i, _ in got if q == 50][:1] == [(1, 52)]


def test_lengths_are_searched_for_themselves(spark, monkeypatch):
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(vectors(60, 8))]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 2.0]), (102, [-1.0, 0.0, 1.0]), (150, [4.0]), (151, [-2.0]), (200, [3.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = found(frame, every=50)
    assert got == by_sql(rows)
    assert [r[:3] for r in got if r[0] >= 100] == [(100, 1, 101), (100, 2, 102), (150, 1, 151)]
    # long vectors are turned in parts, and blocks of few components are searched one by one
    monkeypatch.setattr(A, "TURNED", 3)
    monkeypatch.setattr(A, "NUMBERS", 10)
    assert found(frame, every=50) == got


def test_turning_in_parts_keeps_lengths_and_angles(monkeypatch):
    x = vectors(20, 50).astype(float)
    monkeypatch.setattr(A, "TURNED", 16)
    assert np.allclose(A.turn(x) @ A.turn(x).T, x @ x.T)


def test_blocks_of_queries(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(300, 16))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = found(frame, every=5)
    monkeypatch.setattr(A, "QUERIES", 20)
    monkeypatch.setattr(A, "CHUNK", 7)
    assert found(frame, every=5) == whole


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{samples.SF_DIR}/embeddings.parquet'")
    names = ["query_id", "rank", "vec_id", "score"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({A.ORACLE_SQL})").fetchall())
    got = A.op2_nearest(spark, samples.SF_DIR)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
