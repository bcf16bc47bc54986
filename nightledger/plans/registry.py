"""All named queries: name -> function of a warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from nightledger.plans import insights, library, measures, pricing, stages, summary, views

MODULES = [stages, library, measures, views, summary, insights, pricing]


def all_queries() -> dict[str, Callable[..., DataFrame]]:
    found: dict[str, Callable[..., DataFrame]] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return dict(sorted(found.items()))
