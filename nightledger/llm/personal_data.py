"""Personal data in texts: fixed patterns, and credentials found by weak supervision.

Emails, IP addresses, card and phone numbers are the leftmost non-overlapping matches of
fixed patterns that pass a check. Other spans come from a span classifier that no one
labelled data for: tokens that mix letters and digits are candidates; labelers (patterns, a
word list, the context) vote for or against each, or abstain; expectation-maximisation over
the vote patterns estimates how reliable each labeler is and how likely each candidate is a
credential; a naive Bayes classifier of the span's form, trained on these probabilities from
all candidates, decides (kind ``secret``).

Only DataFrame functions touch the rows. The driver sees counts of at most 3**6 vote
patterns and of the forms' classes. Offsets are code points, ends exclusive.

Patterns are written without backtracking over long runs (possessive repeats, matches begin
where a run begins or the match before ended), which doesn't change what they match.

Defined cases: null is an empty text; a text without a match gives no spans; without any
candidate no secret is found; repeated rows and null doc_ids get their own results.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])[A-Za-z]*+[0-9][A-Za-z0-9]{7,}+(?!@)"
#: Words that announce a credential.
WORDS = ["password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "credential", "auth", "bearer"]
ROUNDS = 50
CHUNK = 256
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

SPAN = "struct<start: int, end: int, value: string>"


def _matches(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (start, end, value); both arrays of the pattern's pieces come from one pass each."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    return F.when(possible, F.struct(found.alias("found"), pieces.alias("pieces")))


def _spans(parts: Column) -> Column:
    """Positions from the lengths of matches and of what lies between, in chunks: the list that
    a fold copies at each step stays short."""
    found, pieces = parts["found"], parts["pieces"]
    empty = F.array().cast(f"array<{SPAN}>")

    def one(state: Column, i: Column) -> Column:
        value = F.get(found, i)
        start = state["at"] + F.length(F.get(pieces, i))
        end = start + F.length(value)
        span = F.struct(start.alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(state["list"], F.array(span)).alias("list"))

    def chunk(state: Column, i: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), empty.alias("list"))
        last = F.least(i + CHUNK, F.size(found)) - 1
        inner = F.aggregate(F.sequence(i, last), begin, one)
        return F.struct(inner["at"].alias("at"), F.concat(state["lists"], F.array(inner["list"])).alias("lists"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("lists"))
    folded = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(CHUNK)), begin, chunk, lambda s: F.flatten(s["lists"]))
    return F.when(F.size(found) > 0, folded).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _checked(kind: str) -> Column:
    """The spans of a kind that pass its check."""
    kept = F.filter(kind, lambda span: _passes(kind, span["value"]))
    return F.coalesce(kept, F.array().cast(f"array<{SPAN}>"))


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _candidates(text: Column, spans: Column) -> Column:
    """Spans with votes (1, -1, or 0: abstains) and form (classes of the span itself)."""

    def judged(span: Column) -> Column:
        value = span["value"]
        left = F.substr(text, F.greatest(span["start"] - 24, F.lit(0)) + 1, F.least(span["start"], F.lit(24)))
        word = F.lower(F.regexp_extract(left, r"([A-Za-z_]+)[^A-Za-z_]{0,4}$", 1))
        hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        turns = F.length(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), "[A-Za-z]+", "a"))
        size = F.length(value)
        votes = [
            F.when(value.rlike("^[A-Z]{4}[0-9A-Z]{16}$"), 1).otherwise(0),
            F.when(hexadecimal & (size >= 16), 1).when(size < 12, -1).otherwise(0),
            F.when(word.isin(WORDS), 1).otherwise(0),
            F.when(left.rlike(r"[=:]\s?[\"']?$"), 1).when(left.rlike(r"(?:^|[\s(])$"), 0).otherwise(-1),
            F.when(turns >= 5, 1).when(turns <= 2, -1).otherwise(0),
            F.when(size >= 16, 1).when(size <= 10, -1).otherwise(0),
        ]
        digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        upper = F.length(F.regexp_replace(value, "[^A-Z]", ""))
        form = [
            F.least(F.floor(size / 4), F.lit(12)),
            F.floor(digits * 5 / size),
            F.floor(upper * 5 / size),
            F.least(F.floor(turns / 2), F.lit(8)),
            hexadecimal.cast("long"),
        ]
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            F.array(*[v.cast("int") for v in votes]).alias("votes"),
            F.array(*[x.cast("long") for x in form]).alias("form"),
        )

    return F.transform(F.filter(spans, lambda s: s["value"].rlike("[A-Za-z]")), judged)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone: checked spans, candidates), written: the one pass over texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = text.rlike("[0-9]")
    possible = {
        "email": F.contains(text, F.lit("@")),
        "ip": number & text.rlike(r"[0-9]\.[0-9]"),
        "card": number,
        "phone": F.contains(text, F.lit("+")),
    }
    rows = docs.select(
        F.col("doc_id").cast("long"),
        text.alias("text"),
        *[_matches(text, p, possible[k]).alias(k) for k, p in PATTERNS.items()],
        _matches(text, CANDIDATE, number).alias("candidates"),
    )
    rows = rows.select("doc_id", "text", *[_spans(F.col(k)).alias(k) for k in (*PATTERNS, "candidates")])
    rows = rows.select(
        "doc_id",
        *[_checked(k).alias(k) for k in PATTERNS],
        _candidates(F.col("text"), F.col("candidates")).alias("candidates"),
    )
    return stage(rows)


def reliabilities(patterns: list[tuple[list[int], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of positives, and P(vote | positive), P(vote | negative) of each labeler.

    Each labeler starts out, and is held by a few made-up counts, as one that is more often
    right than wrong; so the two classes can't change places.
    """
    labelers = len(patterns[0][0]) if patterns else 0
    pseudo = {1: (2.0, 0.5), 0: (2.0, 2.0), -1: (0.5, 2.0)}
    law = [{v: (p / 4.5, q / 4.5) for v, (p, q) in pseudo.items()} for _ in range(labelers)]
    share = 0.5
    for _ in range(ROUNDS if patterns else 0):
        sums = [{v: list(p) for v, p in pseudo.items()} for _ in range(labelers)]
        positive, total = 1.0, 2.0
        for votes, n in patterns:
            p = _probability(share, law, votes)
            positive, total = positive + n * p, total + n
            for j, v in enumerate(votes):
                sums[j][v][0] += n * p
                sums[j][v][1] += n * (1 - p)
        share = positive / total
        law = [
            {v: (c[0] / sum(x[0] for x in s.values()), c[1] / sum(x[1] for x in s.values())) for v, c in s.items()}
            for s in sums
        ]
    return share, law


def _probability(share: float, law: list[dict[int, tuple[float, float]]], votes: list[int]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(x[v][0] / x[v][1]) for x, v in zip(law, votes, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _table(key: Column, values: dict, other: float) -> Column:
    """The value of a key in a small table, as a chain of cases."""
    return reduce(lambda rest, x: F.when(key == x[0], F.lit(x[1])).otherwise(rest), values.items(), F.lit(other))


def fit(scanned: DataFrame):
    """A function from a candidate's form to the log odds that it is a credential."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.votes", "c.form")
    patterns = [(r["votes"], r["n"]) for r in each.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    share, law = reliabilities(patterns)
    posterior = {",".join(map(str, v)): _probability(share, law, v) for v, _ in patterns}
    votes = F.array_join(F.transform("votes", lambda v: v.cast("string")), ",")
    soft = each.select("votes", F.posexplode("form").alias("place", "class")).groupBy("votes", "place", "class").agg(F.count("*").alias("n"))
    weight = _table(votes, posterior, 0.5) if posterior else F.lit(0.5)
    soft = soft.groupBy("place", "class").agg(F.sum(F.col("n") * weight).alias("yes"), F.sum(F.col("n") * (1 - weight)).alias("no"))
    rows = soft.orderBy("place", "class").collect()
    totals: dict[int, list[float]] = {}
    for r in rows:
        t = totals.setdefault(r["place"], [0.0, 0.0, 0])
        t[0], t[1], t[2] = t[0] + r["yes"], t[1] + r["no"], t[2] + 1
    tables: dict[int, dict[int, float]] = {}
    for r in rows:
        yes, no, kinds = totals[r["place"]]
        ratio = (r["yes"] + 0.5) / (yes + 0.5 * kinds) / ((r["no"] + 0.5) / (no + 0.5 * kinds))
        tables.setdefault(r["place"], {})[r["class"]] = round(math.log(ratio), 9)
    prior = round(math.log(share / (1 - share)), 9)
    return lambda form: sum((_table(F.get(form, F.lit(p)), t, 0.0) for p, t in tables.items()), F.lit(prior))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, secret): arrays of (start, end) spans, one row per row of docs."""
    scanned = scan(docs)
    odds = fit(scanned)
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    chosen = F.filter("candidates", lambda c: odds(c["form"]) > 0)
    empty = F.array().cast("array<struct<start: int, end: int>>")
    return scanned.select(
        "doc_id",
        *[F.transform(k, bare).alias(k) for k in PATTERNS],
        F.coalesce(F.transform(chosen, bare), empty).alias("secret"),
    )


def _listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, joined by commas."""

    def written(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[written(k) for k in kinds]), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(_listed(list(PATTERNS)), 256).alias("base_sha256"),
        _listed([*PATTERNS, "secret"]).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
    )
