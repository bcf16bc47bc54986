"""The queries of this subpackage by name, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    chaining,
    collocations,
    dart_minhash,
    decontaminate,
    html_extraction,
    language_id,
    mixing,
    one_bit_ann,
    personal_data,
    pseudo_likelihood,
    sharding,
    url_filter,
    whitening,
)
from .shipping import shipped

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    known = [
        decontaminate.op1_decontaminate,
        one_bit_ann.op2_nearest,
        mixing.op3_mixing,
        chaining.op4_repeated_passages,
        pseudo_likelihood.op5_pseudo_likelihood,
        dart_minhash.op6_near_duplicates,
        personal_data.op7_personal_data,
        url_filter.op8_url_filter,
        sharding.op9_shards,
        language_id.op10_language_id,
        whitening.op11_whitening,
        collocations.op12_collocations,
        html_extraction.op13_main_text,
    ]
    own = {f.__name__: shipped(f) for f in known}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_nearest": one_bit_ann.ORACLE_SQL,
        "op3_mixing": mixing.ORACLE_SQL,
        "op12_collocations": collocations.ORACLE_SQL,
    }
