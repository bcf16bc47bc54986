"""Base spans against Python's patterns; votes, reliabilities and the span classifier."""

import hashlib
import random
import re

import pytest

from nightledger.llm import personal_data as P

from . import samples

# The patterns that the base spans are defined by.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and plain_luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in BASE.items()}


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in P.find(frame).collect()}


def assert_base(rows, texts):
    for i, text in enumerate(texts):
        for kind, spans in plain_spans(text).items():
            assert [tuple(s) for s in rows[i][kind]] == spans, (i, kind, text and text[:80])


def test_base_spans_of_odd_texts(spark):
    texts = [
        None, "", "nothing here", "a@b.c_d@e.f x a@b.c%d@e.f ..@-.- é@x.yz ü.a@b.c. @@a@b a@b..c a@.b",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3 1.2.3.4.", "9" * 400 + ".1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111234 1 2 3 4111  1111",
        "+1 (679) 555-1339 +12345678901234567 +1--- +49.30.123456) ++1 23456789 +1 +2 +3 4",
        "x" * 9000 + "1" * 9000 + "@" + "a." * 4000 + "9", "é😀 a@b.co 😀 1.1.1.1 +1 2345 6789 " * 700,
        "1 " * 9000, "1-" * 9000 + "x", "a" * 30000, "+1" + "(" * 20000, "1.1.1." * 5000,
    ]
    assert_base(found(spark, texts), texts)


def test_base_spans_of_random_texts(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("1234a@.+-( )%_é\n") for _ in range(rnd.randrange(120))) for _ in range(400)]
    digits = ["".join(rnd.choice("123456789 -") for _ in range(60)) for _ in range(200)]
    assert_base(found(spark, texts + digits), texts + digits)


def test_secrets_are_found_and_words_are_left_alone(spark):
    rnd = random.Random(3)
    hexadecimal = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n - 1)) + "7"
    secrets = [hexadecimal(20 + i % 20) for i in range(40)]
    texts = [f'{samples.prose(9, i)} password={s} then token: "{s}" end' for i, s in enumerate(secrets)]
    clean = ["In 2024 the A4 paper and 3rd edition of covid19 cases, call 12345678 now", samples.prose(80, 5)] * 20
    rows = found(spark, texts + clean)
    for i, s in enumerate(secrets):
        assert [texts[i][a:b] for a, b in rows[i]["secret"]] == [s, s]
    assert not any(rows[i]["secret"] for i in range(len(texts), len(texts + clean)))


def test_reliabilities_recover_the_labelers():
    rnd = random.Random(1)
    true = [(0.9, 0.1), (0.8, 0.05), (0.6, 0.3)]
    patterns = {}
    for _ in range(20_000):
        positive = rnd.random() < 0.3
        votes = tuple(1 if rnd.random() < law[not positive] else -1 for law in true)
        patterns[votes] = patterns.get(votes, 0) + 1
    share, law = P.reliabilities([(list(v), n) for v, n in patterns.items()])
    assert share == pytest.approx(0.3, abs=0.05)
    for got, (yes, no) in zip(law, true, strict=True):
        assert got[1][0] == pytest.approx(yes, abs=0.08) and got[1][1] == pytest.approx(no, abs=0.08)


def test_odd_rows_and_empty_table(spark):
    docs = spark.createDataFrame(samples.odd_rows(), samples.SCHEMA)
    assert P.find(docs).count() == docs.count()
    assert P.find(spark.createDataFrame([], samples.SCHEMA)).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in P.op7_personal_data(spark, samples.SF_DIR).collect()}
    docs = spark.read.parquet(f"{samples.SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        spans = plain_spans(r.text)
        listed = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans[k])
        row = got[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in BASE] == [len(spans[k]) for k in BASE]
        rest = row.spans.removeprefix(listed).lstrip(",")
        assert all(x.startswith("secret:") for x in rest.split(",") if x)


def test_no_python_on_the_main_path(spark):
    plan = P.op7_personal_data(spark, samples.SF_DIR)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
