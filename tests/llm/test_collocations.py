"""Phrases against a plain count and the SQL, the trie against sets, odd rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from nightledger.llm import collocations as C

from . import samples

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    good = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in good.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    out = {}
    for (lang, w), a in good.items():
        if 100 * longer[lang, w] >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def found(frame, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in C.collocations(frame, **kw).collect())


def some_texts(n=400, seed=1):
    rnd = random.Random(seed)
    stock = ["new york city", "Sao Paulo", "é à", "of the", "AB cd\tef", "über Ämter gut"]
    rows = []
    for i in range(n):
        words = [rnd.choice(stock) if rnd.random() < 0.3 else f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(rnd.randrange(60))]
        marks = [rnd.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", " ! "]) for _ in words]
        rows.append((rnd.choice(["en", "en", "en", "de", "", None, "und"]), "".join(w + m for w, m in zip(words, marks))))
    return rows


def frame_of(spark, rows):
    data = [(lang, text, "x", 1, 2, "y") for lang, text in rows]
    return spark.createDataFrame(data, "lang string, text string, word string, n long, a long, phrase string").repartition(4)


def test_both_ways_against_a_plain_count(spark):
    rows = some_texts()
    frame, want = frame_of(spark, rows), plain(rows)
    assert len(want) > 100 and any(r[2].count(" ") == 2 for r in want)
    assert found(frame) == want
    assert found(frame, n_phrases=5) == want
    assert found(frame, n_words=5) == want
    assert found(frame, least=3, top=7) == plain(rows, 3, 7)


def test_trie_against_sets():
    rng = np.random.default_rng(1)
    for n in (3, 20, 5000):
        pairs = np.unique(np.minimum(rng.zipf(1.3, (4000, 2)) - 1, n - 1), axis=0)
        triples = np.unique(np.stack([rng.integers(0, len(pairs), 3000), rng.integers(0, n, 3000)], axis=1), axis=0)
        trie = C.Trie(n, pairs, triples)
        assert trie.size == len(pairs) + len(triples)
        assert len(trie.base) <= n + C.RADIX * 2 + (C.RADIX + 2 * trie.digits) * trie.size
        held = [tuple(p) for p in pairs.tolist()]
        place = {p: i for i, p in enumerate(held)} | {(*held[i], w): len(held) + j for j, (i, w) in enumerate(triples.tolist())}
        text = np.where(rng.random(20_000) < 0.05, -1, np.minimum(rng.zipf(1.3, 20_000) - 1, n - 1))
        joined = rng.random(20_000) < 0.8
        joined[-1] = False
        got = {int(at): [] for m in C.matched(trie, text, joined) for at in m[0]}
        for at, state in C.matched(trie, text, joined):
            for i, s in zip(at.tolist(), state.tolist()):
                got[i].append(int(trie.index[s]))
        for i in range(len(text)):
            want = []
            if i + 1 < len(text) and joined[i] and tuple(text[i : i + 2].tolist()) in place:
                want.append(place[tuple(text[i : i + 2].tolist())])
                if joined[i + 1] and tuple(text[i : i + 3].tolist()) in place:
                    want.append(place[tuple(text[i : i + 3].tolist())])
            assert got.get(i, []) == want


def test_words_of_a_block():
    code, known, joined = C.words(pa.array([t + "\n" for t in ["A b,  a\tÄ", "", "..", "b"]], pa.large_string()))
    assert [known[c].as_py().decode() for c in code] == ["a", "b", "a", "Ä", "b"]
    assert joined.tolist() == [True, False, True, False, False]
    assert len(C.words(pa.array([], pa.large_string()))[0]) == 0


def test_products_beyond_64_bits(spark):
    big = 3 * 10**9
    single = spark.createDataFrame([("x", "a", big), ("x", "b", big + 1), ("x", "c", big + 5)], "lang string, word string, n long")
    phrases = spark.createDataFrame([("x", "a b", 2, big - 7), ("x", "b c", 2, big - 1), ("x", "a b c", 3, big - 9)], "lang string, phrase string, k int, a long")
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in C.scored(single, phrases).collect()}
    a = big - 9
    cuts = [(10**6 * a * a // (big * (big - 1)), big, big - 1), (10**6 * a * a // ((big - 7) * (big + 5)), big - 7, big + 5)]
    assert got["a b c"] == min(cuts, key=lambda c: c[0])
    assert got["a b"][0] == 10**6 * (big - 7) ** 2 // (big * (big + 1))


def test_query_against_its_sql(spark):
    from nightledger.llm.registry import oracle_sql, queries

    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries()["op12_collocations"](spark, samples.SF_DIR).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{samples.SF_DIR}/documents.parquet'")
    want = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op12_collocations']})").fetchall())
    assert got == want and len(got) > 50


def test_odd_rows(spark):
    odd = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    got = found(odd)
    assert got == plain([(r["lang"], r["text"]) for r in odd.collect()]) and got
    assert found(odd.limit(0)) == []
    assert found(frame_of(spark, [("en", None), ("en", " .,"), (None, "one")])) == []


def test_many_phrases_are_counted_by_numbers(spark, monkeypatch):
    rows = some_texts()
    frame, want = frame_of(spark, rows), plain(rows)

    def refused(*_):
        raise AssertionError("phrases were shuffled as texts")

    monkeypatch.setattr(C, "counted_by_shuffle", refused)
    phrases = C.collocations(frame, top=10**6).count()
    for bound in (0, phrases // 2, 2 * phrases):
        assert found(frame, n_phrases=bound) == want


def test_sieve_holds_all_pairs(spark):
    pairs = np.unique(np.random.default_rng(4).integers(0, 1 << 53, 5000))
    held = C.sieve(spark.createDataFrame([(int(p), 1) for p in pairs], "key long, n long"))
    bit = C._bit(pairs)
    assert bit.min() >= 0 and bit.max() < 1 << C.SIEVE and len(held) == 1 << C.SIEVE - 6
    assert (held[bit >> 6] >> (bit & 63) & 1 == 1).all()
    assert sum(int(x).bit_count() for x in held[held != 0].view(np.uint64)) == len(np.unique(bit))
