"""DartMinHash: darts, classes against all pairs, hubs, odd rows."""

import numpy as np

from nightledger.llm import dart_minhash as D
from nightledger.llm.components import components
from nightledger.llm.text import words

from . import samples


def plain_classes(rows):
    """Smallest doc_id of each document's class, from all pairs."""
    bags = [samples.plain_bag(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (bags[i] and bags[j] and samples.plain_jaccard(bags[i], bags[j]) >= 0.8):
                above[root(i)] = root(j)
    members = {}
    for i, (doc, _) in enumerate(rows):
        members.setdefault(root(i), []).append(doc)
    return {doc: min(docs) for docs in members.values() for doc in docs}


def test_share_of_equal_darts_is_the_similarity():
    a = samples.prose(3000, 1)
    b = samples.edited(a, 40) + " " + samples.prose(300, 2)
    kept, _ = D.signatures(words([a, b, a]), k=2000)
    expected = samples.plain_jaccard(samples.plain_bag(a), samples.plain_bag(b))
    assert abs((kept[0] == kept[1]).mean() - expected) < 0.04
    assert (kept[0] == kept[2]).all() and np.isfinite(kept).all()


def test_weights_count():
    kept, total = D.signatures(words(["a b c d e " * 50, "a b c d e " * 5]), k=1000)
    one, two = (samples.plain_bag("a b c d e " * n) for n in (50, 5))
    assert total.tolist() == [sum(one.values()), sum(two.values())]
    assert abs((kept[0] == kept[1]).mean() - samples.plain_jaccard(one, two)) < 0.05


def test_classes_equal_all_pairs(spark):
    rows = []
    for i in range(12):
        base = samples.prose(40 + 30 * i, i)
        rows += [base, base, samples.edited(base, 90), samples.edited(base, 30), base + " tail of it", base.upper()]
    rows += [samples.prose(80, 100 + i) for i in range(30)] + ["", "", "!!", "!!", "??", "a b", "A b.", "a c"]
    rows = list(enumerate(rows, 5))
    got = D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == plain_classes(rows)


def test_copies_that_only_resemble_their_source_are_one_class(spark):
    source = samples.prose(300, 3, 5000).split(" ")
    rows = [(900, " ".join(source))]
    for i in range(60):  # alike only through the source: 0.83 to it, 0.7 to each other
        w = list(source)
        for j in range(6):
            w[(i * 5 + j * 47) % 300] = f"other{i}n{j}"
        rows.append((i, " ".join(w)))
    bags = [samples.plain_bag(t) for _, t in rows]
    assert min(samples.plain_jaccard(bags[0], b) for b in bags) >= 0.8
    assert samples.plain_jaccard(bags[5], bags[30]) < 0.8
    got = D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {61}


def test_one_of_each_keeps_columns_and_one_row(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    kept = D.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    # the null and empty texts are one class, both long texts, and the texts of two words
    assert [r[1] for r in rows] == [1, 3, 4, 6, 8, 0]
    empty = spark.createDataFrame([], samples.SCHEMA)
    assert D.one_of_each(empty).count() == 0 and D.near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
