"""Hosts, rules, the best split of names over all splits, and verdicts of names."""

import itertools
import math
import re

import pytest

from nightledger.llm import url_filter as U

from . import samples


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fits = [
        (len(name + start), name + start, kind)
        for kind, name, start in U.RULES
        if (host == name or host.endswith("." + name)) and path.startswith(start)
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "https://a.example.net/en/1", "http://example.net/fr/", "https://EXAMPLE.com/de/x?q#f", "x://example.com",
    "https://b.org/fr/2", "https://notexample.com/de/", "https://x.net?y=/", "https://x.net/", "ftp://É.NET/en/",
    "no scheme", "", None, "://", "a://b://c/d", "https://org/fr/", "https://anet/", "https://e.example.net/en", "h://h\n/p\nq?r",
]


def test_hosts_paths_and_rules(spark):
    frame = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    for r in U.judge(frame).collect():
        host, path = plain_parts(URLS[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")


def test_split_is_the_best_of_all():
    words = U.Words({"the": 90, "a": 60, "cat": 20, "at": 30, "hec": 2, "sat": 10})
    for run in ("thecat", "acatsat", "xthe", "zzz", "satthea", "a"):
        def cost(parts):
            return sum(words.cost.get(p, math.log(words.total) + (len(p) - 1) * math.log(10)) for p in parts)
        cuts = itertools.product([0, 1], repeat=len(run) - 1)
        every = ["".join(c + ("|" if k else "") for c, k in zip(run, [*cut, 0], strict=True)).split("|") for cut in cuts]
        assert cost(words.split(run)) == pytest.approx(min(map(cost, every)))


def test_company_of_the_seeds_is_blocked(spark):
    titles = "<title>sunny garden tools and green tea with winning bonus offers</title>"
    rows = [(i, f"https://casinobonus{'win' * (i % 2)}.com/offers/{i}", titles) for i in range(40)]
    rows += [(100 + i, f"https://gardentools.com/greentea/{i}", titles) for i in range(300)]
    rows += [(900, "https://bonusoffers.com/offers/7", titles), (901, "https://sunnygarden.com/tea", titles)]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "block" for i in range(40)) and all(got[100 + i] == "allow" for i in range(300))
    assert got[900] == "block" and got[901] == "allow"


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, odds int"
    rows = [(None, None, None, "x", 1), (1, "https://b.com/" + "a" * 5000, "<TITLE>\nlong\n</title>", None, 2)] * 2
    assert U.judge(spark.createDataFrame(rows, schema)).count() == 4
    assert U.judge(spark.createDataFrame([], schema)).count() == 0


def test_query(spark):
    got = U.op8_url_filter(spark, samples.SF_DIR).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{samples.SF_DIR}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path = plain_parts(pages[r.page_id])
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (("allow", "block") if not rule else (verdict,))
