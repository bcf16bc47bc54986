"""Run queries on Spark and their SQL on DuckDB, and compare rows, names and types."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return [(v is None, str(type(v)), str(v) if not isinstance(v, float) else f"{v:.6g}") for v in row]


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(df, con, text: str) -> list[str]:
    problems = []
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    theirs = cur.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return [f"columns {sorted(set(columns) ^ set(names))}"]
    for c, kind in df.dtypes:
        if TYPES.get(kind) != kinds[c]:
            problems.append(f"type of {c}: {kind} / {kinds[c]}")
    ours = [tuple(r) for r in df.select(*columns).collect()]
    place = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in place) for r in theirs]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} / {len(theirs)}")
    if not ours:
        problems.append("no rows")
    wrong, inexact = [], 0
    for a, b in zip(sorted(ours, key=_key), sorted(theirs, key=_key)):
        if a != b:
            if all(_same(x, y) for x, y in zip(a, b)):
                inexact += 1
            else:
                wrong.append((dict(zip(columns, a)), dict(zip(columns, b))))
    if wrong:
        a, b = wrong[0]
        problems.append(f"{len(wrong)} rows differ: " + str({c: (a[c], b[c]) for c in a if a[c] != b[c]}))
    if inexact:
        problems.append(f"{inexact} rows differ in the last bits")
    return problems


def main(sf_dir: str, *wanted: str) -> None:
    import __spark_entry__ as e
    from nightledger.session import build_session

    # COMPARE_CONF="key=value,key=value" adds session settings, e.g. to switch broadcasts off
    pairs = os.environ.get("COMPARE_CONF", "")
    extra = dict(p.split("=", 1) for p in pairs.split(",") if p)
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "10g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-"),
            **extra,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, texts = connect(sf_dir), e.oracle_sql()
    bad = 0
    for name, run in e.queries().items():
        if wanted and not any(name.startswith(x) for x in wanted):
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in texts:
                problems = compare(df, con, texts[name])
            else:
                problems = [f"no sql, {len(df.collect())} rows"]
        except Exception as x:  # noqa: BLE001
            problems = [f"{type(x).__name__}: {str(x)[:600]}"]
        bad += bool(problems) and not problems[0].startswith("no sql")
        print(f"{name:32s} {time.time() - t:6.2f}s", "ok" if not problems else problems, flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
