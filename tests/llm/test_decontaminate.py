"""Benchmark passages against every window of every text."""

import collections

from nightledger.llm import decontaminate as D

from . import samples


def plain_matches(docs, items):
    """Best window of each text for each item, over all windows."""
    out = {}
    for doc, text in docs:
        w = samples.plain_words(text)
        shingles = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for item, body in items:
            v = samples.plain_words(body)
            own = collections.Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4))
            n = min(sum(own.values()), len(shingles))
            best = (0, 0)
            for at in range(len(shingles) - n + 1) if n else []:
                window = collections.Counter(shingles[at : at + n])
                best = max(best, (samples.plain_jaccard(window, own), -at))
            if best[0] >= 0.8:
                out[doc, item] = (best[0], -best[1], n + 4)
    return out


def test_equals_all_windows(spark):
    items = [(i, samples.prose(12 + 9 * i, 50 + i, 3000)) for i in range(8)] + [(90, "too short"), (91, None), (92, "")]
    docs = [(i, samples.prose(200, i, 3000)) for i in range(20)]
    for i, (_, body) in enumerate(items[:8]):
        docs.append((100 + i, samples.prose(70, 200 + i) + "\n" + body.upper() + ". " + samples.prose(40, 300 + i)))
        docs.append((200 + i, samples.prose(30, 400 + i) + " " + samples.edited(body, 45) + " " + samples.prose(9, i)))
        docs.append((300 + i, " ".join(body.split(" ")[2:])))
    docs += [(400, items[3][1] + " " + samples.prose(30, 9) + " " + items[3][1] + " " + items[5][1])]
    docs += [(401, ""), (402, None), (403, "a b c"), (404, (items[0][1] + " ") * 40)]
    docs = docs + [docs[21]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = D.contaminated(frame, bench).collect()
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.words) for r in got}
    assert found == plain_matches(docs, [x for x in items if x[1]])
    repeated = docs[21][0]
    assert [r.doc_id for r in got].count(repeated) == 2 * len({i for d, i in found if d == repeated})


def test_fingerprints_within_the_radius_are_found():
    import numpy as np

    index = D.build([(i, samples.prose(40, i, 5000)) for i in range(50)])
    rnd = np.random.default_rng(1)
    for item in range(50):
        bits = np.unpackbits(index.prints[item].view(np.uint8))
        flip = rnd.choice(256, D.RADIUS, replace=False)
        bits[flip] ^= 1
        changed = np.packbits(bits).view(np.uint64)[None]
        assert item in index.candidates(changed)[1]
        bits[(set(range(256)) - set(flip.tolist())).pop()] ^= 1
        assert item not in index.candidates(np.packbits(bits).view(np.uint64)[None])[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0
    bench = spark.createDataFrame([(1, samples.prose(60, 2)), (None, "some text of no one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert got == {(8, 1), (None, None)}
    assert D.contaminated(spark.createDataFrame([], samples.SCHEMA), bench).count() == 0


def test_more_items_than_one_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", 4)
    items = [(i, samples.prose(30, i, 5000)) for i in range(10)]
    docs = spark.createDataFrame([(i, "x " + t) for i, t in items], "doc_id long, text string")
    got = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(10)]
