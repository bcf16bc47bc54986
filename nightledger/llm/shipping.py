"""Sends this subpackage's code to the executors, for sessions where it isn't installed there."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the driver serves a zip of the package to each Python worker."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    package = os.path.basename(os.path.dirname(here))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr(f"{package}/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"{package}/llm/{name}")
    path = os.path.join(tempfile.mkdtemp(prefix="shipped-"), f"{package}_llm.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, after its session has the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run
