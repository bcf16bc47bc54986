"""Exact interpolated quantiles that never bring a whole group into one task.

Rows are first reduced to (group, value, count), which spreads a hot group over its
values. A coarse histogram with a bounded number of buckets locates the buckets that
hold the wanted ranks, and only those buckets are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Buckets per e-fold of magnitude; doubles span about 710 e-folds on each side of zero.
RESOLUTION = 4096

BUCKET = f"CAST(signum(_v) * floor(ln(1 + abs(_v)) * {RESOLUTION}) AS BIGINT)"


def _low(p: float) -> str:
    return f"floor((_total - 1) * {p}D)"


def _high(p: float) -> str:
    return f"ceil((_total - 1) * {p}D)"


def _holds(rank: str, start: str, size: str) -> str:
    return f"({rank} >= {start} AND {rank} < {start} + {size})"


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """One row per non-null ``by`` group; ``probs`` maps an output name to a probability.

    Linear interpolation between the two neighbouring order statistics. Missing values
    are ignored; a group with no value at all gives no row.
    """
    by = by or []
    keys = [f"`{c}`" for c in by]
    group = f"PARTITION BY {', '.join(keys)}" if by else ""
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    # The bucket test repeats what the join below implies, so that both readers of the
    # counts have the same plan and share one shuffle.
    known = [f"{k} IS NOT NULL" for k in keys]
    known += ["_v IS NOT NULL", "NOT isnan(_v)", f"{BUCKET} IS NOT NULL"]
    counts = (
        df.selectExpr(*keys, f"CAST(`{value}` AS DOUBLE) AS _v")
        .where(" AND ".join(known))
        .groupBy(*by, "_v")
        .agg(F.expr("count(1) AS _n"))
        .selectExpr(*keys, "_v", "_n", f"{BUCKET} AS _bucket")
    )
    wanted = [_holds(f(p), "_start", "_size") for p in probs.values() for f in (_low, _high)]
    located = (
        counts.groupBy(*by, "_bucket")
        .agg(F.expr("sum(_n) AS _size"))
        .selectExpr(
            *keys,
            "_bucket",
            "_size",
            f"sum(_size) OVER ({group}) AS _total",
            f"sum(_size) OVER ({group} ORDER BY _bucket {running}) - _size AS _start",
        )
        .where(" OR ".join(wanted))
        .drop("_size")
    )
    opened = counts.join(located, [*by, "_bucket"])
    if by:
        # a group holds only its opened buckets now; one shuffle serves both steps below
        opened = opened.repartition(*by)
    place = f"{group}, _bucket" if by else "PARTITION BY _bucket"
    opened = opened.selectExpr(
        *keys,
        "_v",
        "_n",
        "_total",
        f"_start + sum(_n) OVER ({place} ORDER BY _v {running}) - _n AS _first",
    )
    picked = ["max(_total) AS _total"]
    outputs = []
    for i, (name, p) in enumerate(probs.items()):
        for side, rank in (("lo", _low(p)), ("hi", _high(p))):
            test = _holds(rank, "_first", "_n")
            picked.append(f"max(CASE WHEN {test} THEN _v END) AS _{side}{i}")
        weight = f"((_total - 1) * {p}D - {_low(p)})"
        outputs.append(f"_lo{i} * (1.0D - {weight}) + _hi{i} * {weight} AS `{name}`")
    found = opened.groupBy(*by).agg(*[F.expr(x) for x in picked])
    return found.where("_total IS NOT NULL").selectExpr(*keys, *outputs)


def column_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exactly one row of market-wide quantiles, found in a single pass over ``df``.

    ``wanted`` maps an output name to (column, probability).
    """
    columns = sorted({column for column, _ in wanted.values()})
    probs = {f"q{i}": p for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    cells = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {cells}) AS (name, v)")
    found = exact_quantiles(long, "v", probs, by=["name"])
    name_of = {p: q for q, p in probs.items()}
    return found.agg(
        *[
            F.expr(f"max(CASE WHEN name = '{column}' THEN {name_of[p]} END) AS `{output}`")
            for output, (column, p) in wanted.items()
        ]
    )
