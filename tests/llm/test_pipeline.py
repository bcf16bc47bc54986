"""The pipeline's stages, one after the other, each against a plain version of its rule."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from nightledger.llm import decontaminate, registry
from nightledger.llm.storage import stage

from . import samples
from .test_decontaminate import plain_matches
from .test_near_duplicates import plain_classes


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{samples.SF_DIR}/documents.parquet")
    columns, held = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, samples.SF_DIR))
        held[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        old = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        assert docs.columns[: len(columns)] == columns
        assert set(held[name]) <= {d for d, _ in old} and len(set(held[name])) == len(held[name])
        if name == "language_id":
            assert len(held[name]) >= 0.98 * len(old)
        if name == "near_dedup":
            assert set(held[name]) == set(plain_classes(old).values())
        if name == "decontamination":
            bench = [(r.item_id, r.text) for r in decontaminate._benchmark(spark, samples.SF_DIR).collect()]
            assert set(held[name]) == {d for d, _ in old} - {d for d, _ in plain_matches(old, bench)}
        if name == "mixing":
            assert 0 < len(held[name]) < len(old)
    assert sorted(docs.columns) == sorted([*columns, "shard", "slot"])
    assert sorted(held["sharding"]) == sorted(held["mixing"])


def test_odd_rows_pass_all_stages(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    for rows in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES:
            rows = stage(step(spark, rows, samples.SF_DIR))
        assert sorted(rows.columns) == sorted(docs.columns)


def test_batches_of_texts_are_bounded(spark):
    step = corpus_pipeline.bounded(lambda spark, docs, _: docs)
    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    @F.arrow_udf("long")
    def size(column: pa.Array) -> pa.Array:
        return pa.array([column.nbytes] * len(column))

    held = spark.conf.get(corpus_pipeline.BATCHES)
    try:
        docs = step(spark, docs, "")
        found = {r.n for r in docs.mapInArrow(sizes, "n long").collect()}
        found |= {r.n for r in docs.select(size("text").alias("n")).collect()}
    finally:
        spark.conf.set(corpus_pipeline.BATCHES, held)
    assert max(found) < 2 * corpus_pipeline.BATCH_BYTES


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())
