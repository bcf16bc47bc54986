"""Kneser-Ney models: probabilities, a plain version, held-out accuracy, rejection."""

import collections

import numpy as np
import pandas as pd
import pytest

from nightledger.llm import language_id as L

from . import samples

SENTENCES = {
    "en": "the quick brown fox and the lazy dog were there with the other animals of the farm",
    "de": "der schnelle braune fuchs und der faule hund waren dort mit den anderen tieren",
    "fr": "le renard brun rapide et le chien paresseux étaient là avec les autres animaux",
}


def mixed(lang, seed, n=40):
    rnd = np.random.default_rng(seed)
    return " ".join(rnd.choice(SENTENCES[lang].split(), n))


def counts(order=3):
    rows = []
    for lang in SENTENCES:
        seen = collections.Counter()
        text = " " * order + mixed(lang, 1, 200)
        for i in range(order, len(text)):
            seen[text[i - order + 1 : i + 1]] += 1
        rows += [(lang, g, n) for g, n in seen.items()]
    return pd.DataFrame(rows, columns=["lang", "gram", "n"])


def plain_probability(frame, lang, order):
    """Interpolated Kneser-Ney from its definition, by dictionaries."""
    by_n = {order: {r.gram: r.n for r in frame.itertuples() if r.lang == lang}}
    for n in range(order - 1, 0, -1):
        by_n[n] = collections.Counter(g[1:] for g in by_n[n + 1])
    alphabet = len({g[-1] for g in frame.gram}) + 1

    def probability(gram):
        n = len(gram)
        if not n:
            return 1 / alphabet
        once = sum(c == 1 for c in by_n[n].values())
        twice = sum(c == 2 for c in by_n[n].values())
        discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
        total = sum(c for g, c in by_n[n].items() if g[:-1] == gram[:-1])
        if not total:
            return probability(gram[1:])
        types = sum(g[:-1] == gram[:-1] for g in by_n[n])
        return max(by_n[n].get(gram, 0) - discount, 0) / total + discount * types / total * probability(gram[1:])

    return probability


def test_entropies_equal_the_definition():
    frame = counts()
    model = L.build(frame, 3)
    texts = ["the dog", "Étaient--là 12 z", "zzz qqq", "х"]
    h, size = model.entropies(texts)
    for i, text in enumerate(["the dog ", "étaient là z ", "zzz qqq ", "х "]):
        assert size[i] == len(text)
        for j, lang in enumerate(model.languages):
            p = plain_probability(frame, lang, 3)
            padded = "  " + text
            plain = -np.mean([np.log(p(padded[k : k + 3])) for k in range(len(text))])
            assert h[i, j] == pytest.approx(plain, rel=1e-5)


def test_probabilities_add_to_one():
    frame = counts()
    p = plain_probability(frame, "en", 3)
    letters = sorted({g[-1] for g in frame.gram})
    for context in ("th", "zz", "é "):
        assert sum(p(context + c) for c in [*letters, "\x00"]) == pytest.approx(1)


def test_held_out_accuracy_and_rejection(spark):
    rows = [(i, mixed(lang, i, 8 + i % 40), lang) for i in range(600) for lang in [list(SENTENCES)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    got = L.identify(docs, model).selectExpr("doc_id", "lang", "language.*").collect()
    assert all(r.lang == r.lang_pred and r.accepted and 0 <= r.score <= 1 for r in got)
    rnd = np.random.default_rng(5)
    foreign = [(i, "".join(rnd.choice(list("бвгджзклмнпрст "), 400)), None) for i in range(5)]
    foreign += [(9, "".join(rnd.choice(list("qxzjkvwy "), 400)), None)]
    odd = L.identify(spark.createDataFrame(foreign, docs.schema), model)
    assert not any(r.language.accepted for r in odd.collect())


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, mixed("en", i), "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    only = docs.withColumn("lang", L.F.when(L.bucket(L.F.col("doc_id")) == 0, "xx").otherwise("en"))
    assert L.fit(only).languages == ["en"]


def test_odd_rows(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    got = L.identify(docs, L.fit(docs))
    assert got.columns == docs.columns and got.count() == docs.count()
    for r in got.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.language.lang_pred == "und") == (not letters)
        assert letters or (r.language.score == 0 and not r.language.accepted)
    empty = spark.createDataFrame([], samples.SCHEMA)
    model = L.fit(empty)
    assert L.identify(empty, model).count() == 0
    assert {r.language.lang_pred for r in L.identify(docs, model).collect()} == {"und"}


def test_query(spark):
    from tests.llm.samples import SF_DIR

    got = L.op10_language_id(spark, SF_DIR)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    joined = got.join(L.documents(spark, SF_DIR).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in joined) >= 0.95 * len(joined)
