"""Exact sizes, gapless slots, the law of the matrix, and a lost task's rows."""

import collections
import zlib

import numpy as np
import pytest

from nightledger.llm import sharding as S

from . import samples


def test_matrix_has_the_sums_and_the_law():
    sizes, columns = [5, 0, 7, 20], np.array([11, 11, 10])
    tables = [S.matrix(sizes, columns, seed) for seed in range(4000)]
    assert all((t.sum(axis=1) == sizes).all() and (t.sum(axis=0) == columns).all() for t in tables)
    first = np.array([t[0, 0] for t in tables])
    # hypergeometric: 5 of 32 drawn, 11 of them go to the first shard
    mean = 5 * 11 / 32
    assert first.mean() == pytest.approx(mean, abs=0.06)
    assert first.var() == pytest.approx(mean * (21 / 32) * (27 / 31), abs=0.1)


@pytest.mark.parametrize("shards", [1, 3, 8, 50])
def test_sizes_slots_and_rows(spark, shards):
    rows = [(i % 37, f"text {i % 5}") for i in range(41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.shuffle_into_shards(docs, shards).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_bins_number_a_shard_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(S, "BIN_ROWS", 10)
    docs = spark.range(1000).withColumnRenamed("id", "doc_id").repartition(7)
    got = S.shuffle_into_shards(docs, 4, seed=5).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(250)]
    # neighbours in the input don't stay together
    near = sum(abs(a.doc_id - b.doc_id) == 1 for a, b in zip(got, got[1:], strict=False))
    assert near < 20


def test_every_place_is_equally_likely(spark):
    docs = spark.range(8).withColumnRenamed("id", "doc_id").coalesce(2)
    seen = np.zeros((8, 2))
    for seed in range(60):
        for r in S.shuffle_into_shards(docs, 2, seed=seed * 10).collect():
            seen[r.doc_id, r.shard] += 1
    assert (np.abs(seen - 30) < 18).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    got = S.shuffle_into_shards(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    assert got.count() == docs.count()
    empty = S.shuffle_into_shards(spark.createDataFrame([], samples.SCHEMA))
    assert empty.count() == 0 and dict(empty.dtypes)["slot"] == "bigint"
    with pytest.raises(ValueError, match="at least one"):
        S.shuffle_into_shards(docs, 0)


def test_query(spark):
    got = S.op9_shards(spark, samples.SF_DIR)
    assert dict(got.dtypes) | {} == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
        "shard": "int", "slot": "bigint", "grown_shard": "int",
    }
    rows = got.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{samples.SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
