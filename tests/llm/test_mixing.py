"""Budgets down the tree against a plain water level, prefixes, and the SQL."""

import collections
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from nightledger.llm import mixing as M

from . import samples


def plain_fill(budget, nodes):
    """nodes: name -> (weight, room). Hands out by weight, again and again among those with room."""
    given = dict.fromkeys(nodes, 0.0)
    open_ = {n for n, (w, room) in nodes.items() if w > 0 and room > 0}
    while open_ and budget > 1e-9:
        weight = sum(nodes[n][0] for n in open_)
        full = [n for n in open_ if given[n] + budget * nodes[n][0] / weight >= nodes[n][1] - 1e-12]
        if not full:
            for n in open_:
                given[n] += budget * nodes[n][0] / weight
            break
        for n in full:
            budget -= nodes[n][1] - given[n]
            given[n] = nodes[n][1]
            open_.remove(n)
    return given


def plain_selection(docs, share, epochs, weights, seed):
    node = lambda s: ("web", "books", "forums")[int(s[3:]) % 3] if s else "unknown"
    leaves = collections.defaultdict(list)
    for doc, text, lang, source in docs:
        leaf = (node(source), lang or "unknown", source or "unknown")
        leaves[leaf].append((doc, text, len((text or "").split())))
    room = {k: epochs * sum(t for *_, t in v) for k, v in leaves.items()}
    weigh = lambda level, name: weights[level].get(name, weights[level].get(None, 0.0))
    budgets = {(): float(int(sum(room.values()) / epochs * share))}
    for depth, level in enumerate(M.LEVELS):
        for parent in [b for b in budgets if len(b) == depth]:
            names = {k[depth] for k in room if k[:depth] == parent}
            nodes = {n: (weigh(level, n), sum(r for k, r in room.items() if k[: depth + 1] == (*parent, n))) for n in names}
            for n, given in plain_fill(budgets[parent], nodes).items():
                budgets[(*parent, n)] = given
    out = []
    for leaf, rows in leaves.items():
        left = int(budgets[leaf] + 1e-6)
        for epoch in range(epochs):
            def key(r, epoch=epoch):
                unit = f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}"
                return hashlib.md5(f"{seed}:{epoch}:{unit}".encode()).hexdigest()
            if epoch and not left:
                break
            units = collections.defaultdict(list)
            for r in rows:
                units[key(r)].append(r)
            for _, unit in sorted(units.items()):
                if sum(r[2] for r in unit) > left:
                    left = -1
                    break
                left -= sum(r[2] for r in unit)
                out += [(r[0], epoch) for r in unit]
            if left < 0:
                break
    return sorted(out, key=str)


def table(n=300):
    rows = []
    for i in range(n):
        source = "src0" if i % 3 else f"src{i % 7}"
        lang = ("en", "de", "fr", None)[i % 4] if i % 5 else "en"
        rows.append((i, samples.prose(5 + i * 7 % 60, i), lang, None if i % 50 == 9 else source))
    return rows + [(None, None, None, None), (1000, "", "xx", "src5"), rows[7], rows[7]]


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.6, 2), (1.0, 1), (1.9, 2), (0.0, 1)])
def test_selection_equals_plain(spark, share, epochs):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"domain": M.DOMAINS, "lang": M.LANGUAGES, "source": M.SOURCES}
    got = M.select(docs, share, epochs).select("doc_id", "__epoch").collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == plain_selection(rows, share, epochs, weights, M.SEED)


def test_a_shortage_goes_to_siblings_first(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    even = {None: 1.0}
    got = M.budgets(frame, 800 / 3010, 1, {"domain": even, "lang": even, "source": even}).collect()
    # 400 for each domain, 200 for each language of web: what a lacks stays with b
    assert {r.source: r.budget for r in got} == {"a": 10, "b": 190, "c": 200, "d": 400}
    got = M.budgets(frame, 2900 / 3010, 1, {"domain": even, "lang": even, "source": even}).collect()
    assert {r.source: r.budget for r in got} == {"a": 10, "b": 945, "c": 945, "d": 1000} or sum(r.budget for r in got) >= 2897


def test_query_equals_sql(spark):
    docs = f"{samples.SF_DIR}/documents.parquet"
    got = M.op3_mixing(spark, samples.SF_DIR)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs}'")
    cur = con.execute(M.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())


def test_odd_rows(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    kept = M.keep_mixture(spark, docs, "")
    assert kept.columns == docs.columns
    assert M.select(docs, 5.0, 3).groupBy("__epoch").count().orderBy("__epoch").collect()[0]["count"] == docs.count()
    empty = spark.createDataFrame([], samples.SCHEMA)
    assert M.keep_mixture(spark, empty, "").count() == 0


def test_no_python_on_the_main_path(spark):
    plan = M.op3_mixing(spark, samples.SF_DIR)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert F is not None
