"""Reviews of the given tables refer to their texts; texts are not written with them."""

import datetime as dt
import hashlib

import pytest

from nightledger.plans import stages
from nightledger.plans.warehouse import Warehouse

DAY = dt.datetime(2001, 5, 1)


@pytest.fixture
def own(spark, tmp_path):
    """Four documents, one id twice; twelve orders, one id twice."""
    texts = [(0, "a\nb "), (1, "long " * 500), (2, None), (2, "second row of 2")]
    orders = [(i, 1, DAY) for i in range(12)] + [(4, 1, DAY + dt.timedelta(days=1))]
    lines = [(i, 5 + i % 2, DAY + dt.timedelta(days=n)) for i in range(12) for n in (3, 2)]
    given = {
        "documents": (texts, "doc_id long, text string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_shipdate timestamp"),
        "customer": ([(1, "Ann")], "c_custkey long, c_name string"),
    }
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return Warehouse.of_tables(spark, str(tmp_path))


def digest(text):
    return (None, None) if text is None else (hashlib.md5(text.encode()).hexdigest(), len(text))


def test_texts_stay_out_of_the_review_stages(own):
    own["reviews"], own["raw_reviews"]
    written = set(own._stages) - own.UNWRITTEN
    assert written == {"texts", "review_rows", "reviews_kept"}
    assert [n for n in written if "comments" in own[n].columns] == ["texts"]
    assert "comments" not in own["review_keys"].columns


def test_every_review_gets_its_own_text(own):
    whole = {0: "a b", 1: ("long " * 500).strip(), 3: None}
    # four rows of documents: a text's number is the order's rest by 4
    raw = [(r.id, r.comments_md5, r.comments_length) for r in stages.c15_strip_breaks(own).collect()]
    for rest in (0, 1, 3):
        got = {x[1:] for x in raw if x[0] % 4 == rest}
        assert got == {digest(whole[rest])}
    twice = sorted((x for x in raw if x[0] == 2), key=str)
    assert {x[1:] for x in twice} == {digest(None), digest("second row of 2")} and len(twice) == 2
    assert len(raw) == 13 + 3
    clean = {r.id: (r.comments_md5, r.comments_length) for r in stages.c19_clean_reviews(own).collect()}
    again = {r.review_id: (r.comments_md5, r.comments_length) for r in stages.n08_reviews(own).collect()}
    assert clean == again and len(clean) == 12
    assert {r.id: digest(r.comments) for r in own["reviews_clean"].collect()} == clean
    assert {r.review_id: digest(r.comments) for r in own["reviews"].collect()} == clean
    assert own["raw_reviews"].count() == 16 and "comments" in own["raw_reviews"].columns
