"""From the documents table to shuffled shards of training text, stage by stage.

Each stage is written as Parquet under the shared folder and read again as the next one's
documents. All but the last return the columns of documents; the last adds shard and slot.
SQL can't express the stages, so tests hold each against a brute-force version.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nightledger.llm import dart_minhash, decontaminate, language_id, mixing, sharding
from nightledger.llm.shipping import shipped
from nightledger.llm.storage import stage

#: Bytes of texts that go to a Python worker at once; every step reads smaller blocks of them.
BATCH_BYTES = 1 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The step, after its session bounds batches by bytes: the default, 10,000 texts or 64 MB, is held
    several times over by each task, outside the heap. A bound that the session was built with stays."""

    @functools.wraps(step)
    def run(spark: SparkSession, *args) -> DataFrame:
        if not spark.sparkContext.getConf().contains(BATCHES):
            spark.conf.set(BATCHES, str(BATCH_BYTES))
        return step(spark, *args)

    return run


STAGES = [
    ("language_id", bounded(shipped(language_id.keep_identified))),
    ("near_dedup", bounded(shipped(dart_minhash.keep_one_of_each))),
    ("decontamination", bounded(shipped(decontaminate.keep_uncontaminated))),
    ("mixing", bounded(shipped(mixing.keep_mixture))),
    ("sharding", bounded(shipped(sharding.deal_into_shards))),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
