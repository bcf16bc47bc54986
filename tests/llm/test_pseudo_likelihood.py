"""The fast sums against word-by-word computation, gradients, and what training gains."""

from collections import Counter

import numpy as np
import pytest

from nightledger.llm import pseudo_likelihood as P
from nightledger.llm.text import words

from . import samples


def plain_score(model, text):
    """Every word predicted on its own from its four neighbours."""
    w = words([text])
    own = P.buckets(w)
    total = 0.0
    for i, b in enumerate(own):
        near = [i + s for s in range(-P.SIDE, P.SIDE + 1) if s]
        classes = [model.of_bucket[own[j]] if 0 <= j < len(own) else P.CLASSES for j in near]
        x = np.concatenate([model.network.embedding[c] for c in classes])
        z = np.tanh(x @ model.network.hidden + model.network.hidden_bias) @ model.network.out + model.network.out_bias
        c = model.of_bucket[b]
        total += z[c] - np.log(np.exp(z).sum()) + model.within[b]
    return len(own), total


def corpus(spark, n=150):
    """Every second word tells the next."""
    rnd = np.random.default_rng(2)
    texts = []
    for _ in range(n):
        pick = rnd.integers(0, 8, 200)
        texts.append(" ".join(f"ask{i} answer{i}" for i in pick))
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_scores_equal_word_by_word(spark):
    docs = spark.createDataFrame(
        [(i, samples.prose(30 + i, i, 90)) for i in range(20)] + [(90, "one"), (91, "a b"), (92, ""), (93, None), (94, "!")],
        "doc_id long, text string",
    )
    model = P.fit(docs)
    got = {r.doc_id: r for r in P.score(docs, model).collect()}
    for doc, text in docs.collect():
        n, total = plain_score(model, text or "")
        assert got[doc].words == n and got[doc].log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert (got[doc]["mean"] is None) == (n == 0)


def test_shares_of_a_class_add_to_one():
    of, within, share = P.class_of(np.arange(P.BUCKETS)[::-1] // 50)
    assert np.bincount(of, np.exp(within), P.CLASSES) == pytest.approx(1)
    assert share.sum() == pytest.approx(1)


def test_training_learns_both_sides(spark, monkeypatch):
    monkeypatch.setattr(P, "SAMPLE", 1)
    docs = corpus(spark)
    mean = lambda rounds: P.score(docs, P.fit(docs, rounds)).agg({"mean": "avg"}).first()[0]
    # the pair is known from either of its words, so half of the uncertainty goes
    assert mean(3) > mean(0) + 0.8


def test_gradient_lowers_the_loss():
    rnd = np.random.default_rng(0)
    context, target = rnd.integers(0, P.CLASSES, (400, 4)), rnd.integers(0, P.CLASSES, 400)
    net = P.Network.start(np.full(P.CLASSES, 1 / P.CLASSES))

    def loss():
        x = net.embedding[context].reshape(len(target), -1)
        z = np.tanh(x @ net.hidden + net.hidden_bias) @ net.out + net.out_bias
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(target)), target]).mean()

    before = loss()
    for i in range(5):
        net.train(context, target, i)
    assert loss() < before - 0.3


def test_what_is_gathered_follows_the_corpus(spark):
    def windows(n):
        return sum(len(r.windows) for r in P.gather(corpus(spark, n)).where("windows is not null").collect())

    assert windows(300) > 1.5 * windows(100)


def test_odd_rows(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    got = P.score(docs, P.fit(docs))
    assert got.count() == docs.count() and all(np.isfinite(r.log_likelihood) for r in got.collect())
    empty = spark.createDataFrame([], samples.SCHEMA)
    assert P.score(empty, P.fit(empty)).count() == 0


def test_every_window_is_trained_on(spark):
    docs = spark.createDataFrame([(i, samples.prose(40 + i, i, 90)) for i in range(30)], "doc_id long, text string")
    held = P.gather(docs).where("windows is not null").collect()
    found = np.concatenate([P.near(r.windows, np.array(r.sizes)) for r in held])
    want = []
    for _, text in docs.collect():
        own = [P.BUCKETS] * P.SIDE + P.buckets(words([text])).tolist() + [P.BUCKETS] * P.SIDE
        want += [own[i : i + 2 * P.SIDE + 1] for i in range(len(own) - 2 * P.SIDE)]
    assert sorted(found.tolist()) == sorted(want)


def test_steps_equal_the_plain_gradient():
    rnd = np.random.default_rng(1)
    context, target = rnd.integers(0, P.CLASSES + 1, (P.BATCH, 4)), rnd.integers(0, P.CLASSES, P.BATCH)
    net = P.Network.start(np.full(P.CLASSES, 1 / P.CLASSES))
    x = net.embedding[context].reshape(len(target), -1)
    h = np.tanh(x @ net.hidden + net.hidden_bias)
    z = np.exp(h @ net.out + net.out_bias)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(target)), target] -= 1
    z /= len(target)
    dh = (z @ net.out.T) * (1 - h * h)
    de = np.zeros_like(net.embedding)
    np.add.at(de, context.ravel(), (dh @ net.hidden.T).reshape(-1, P.WIDTH))
    past = net.past()
    net.train(context, target, 0, past)
    want = np.concatenate([g.ravel() for g in (de, x.T @ dh, dh.sum(axis=0), h.T @ z, z.sum(axis=0))])
    assert np.sqrt(np.maximum(past - 1e-6, 0)) == pytest.approx(np.abs(want), rel=1e-3, abs=1e-5)


def test_equal_windows_are_counted_and_dealt_by_neighbours(spark, monkeypatch):
    monkeypatch.setattr(P, "SORTED", 500)
    monkeypatch.setattr(P, "HELD", 100)
    docs = corpus(spark, 20)
    gathered, of = P.gather(docs), P.class_of(np.arange(P.BUCKETS)[::-1])[0]
    classes = np.append(of, P.CLASSES)
    held = P.counted(gathered, spark.sparkContext.broadcast(classes), 2).collect()
    got, places = Counter(), {}
    for place, r in enumerate(held):
        context, target = P.unpacked(np.frombuffer(r.codes, "<u4"))
        for c, t, n in zip(context.tolist(), target.tolist(), np.frombuffer(r.n, "<u8").tolist(), strict=True):
            got[*c[: P.SIDE], t, *c[P.SIDE :]] += n
            assert places.setdefault(tuple(c), place) == place
    want = Counter()
    for r in gathered.where("windows is not null").collect():
        want.update(map(tuple, classes[P.near(r.windows, np.array(r.sizes))].tolist()))
    assert got == want and len(held) > 2


@pytest.mark.parametrize("shared", [8, 1_000])
def test_windows_with_the_same_neighbours_share_a_step(monkeypatch, shared):
    monkeypatch.setattr(P, "SHARED", shared)
    rnd = np.random.default_rng(3)
    kinds = np.unique(rnd.integers(0, P.CLASSES, (6, 4)), axis=0)
    context, target, n = kinds.repeat(2, axis=0), np.tile([3, 9], len(kinds)), rnd.integers(1, 8, 2 * len(kinds))

    def gradient(*windows, n=None):
        net = P.Network.start(np.full(P.CLASSES, 1 / P.CLASSES))
        past = net.past()
        net.train(*windows, 0, past, n)
        return np.sqrt(np.maximum(past - 1e-6, 0))

    every = np.repeat(np.arange(len(n)), n)
    assert gradient(context, target, n=n) == pytest.approx(gradient(context[every], target[every]), rel=1e-3, abs=1e-5)
