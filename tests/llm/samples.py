"""Small documents with planted cases, and plain versions of what operators work on."""

import collections
import random
import re

SF_DIR = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_bag(text, k=5):
    """Counts of k-word shingles; a shorter text is one shingle; None without a word."""
    w = plain_words(text)
    if not w:
        return None
    return collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def plain_jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def prose(n, seed, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"w{int(rnd.paretovariate(0.6)) % vocabulary}x" for _ in range(n))


def edited(text, every):
    """The text with every n-th word replaced."""
    w = text.split(" ")
    return " ".join("changed" if i % every == every - 1 else x for i, x in enumerate(w))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, root int, shard string, slot int, language string, key int"
EXTRA = ("h", 1, "s", 2, "l", 3)


def odd_rows():
    """Nulls everywhere, empty, letterless and long texts, repeated rows and clashing columns."""
    none = (None,) * 11
    long = prose(30_000, 1, 5000)
    rows = [none, none, (1, None, "en", "src1", None, *EXTRA), (None, "some text of no one", None, None, 3, *EXTRA)]
    rows += [(2, "", "en", "src1", 0, *EXTRA), (3, "!!! ... 12 34", "de", None, 9, *EXTRA)]
    rows += [(4, long, "en", "src0", 5, *EXTRA), (5, long + " end", "en", "src0", 5, *EXTRA)]
    rows += [(6, "one two", "fr", "src2", 7, *EXTRA)] * 3
    rows += [(7, "ONE, two!", "fr", "src2", 7, *EXTRA), (8, prose(60, 2), "es", "src3", 1, *EXTRA)]
    return rows
