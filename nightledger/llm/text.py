"""Words, shingles and their hashes, computed with numpy over blocks of texts.

A word is a maximal run of letters and digits (``str.isalnum``) of the lower-cased text.
Texts are read in blocks of a bounded length; a text longer than that is a block alone, so
whole texts are read and memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a shingle, and the similarity from which texts are near copies.
SHINGLE = 5
SIMILAR = 0.8
#: Bytes of text that are turned into arrays at once.
BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers for the places of a run.
ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it belongs to a word, and a random value."""
    known = np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.bool_, 0x110000)
    return known, mix(np.arange(0x110000, dtype=np.uint64))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _POWERS[:] = [
            np.cumprod(np.full(size, x, np.uint64), dtype=np.uint64) for x in (_BASE, inverse)
        ]
    return _POWERS[0], _POWERS[1]


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[str]]]:
    """Cut a batch into runs of rows of bounded length: first row and texts (null: empty)."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 16)
    lo = 0
    while lo < len(texts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        lo = hi


@dataclass
class Words:
    """Hash and text index of each word in order; first word and word count of each text."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray
    count: np.ndarray


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by a line break; where each ends."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered) + "\n"
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends


def words(texts: list[str]) -> Words:
    if not texts:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    point, ends = codes(texts)
    known, value = _letters()
    inside = known[point].view(np.int8)
    step = np.diff(inside, prepend=np.int8(0))
    start = np.flatnonzero(step == 1)
    end = np.flatnonzero(step == -1)
    power, inverse = _powers(len(point) + 1)
    total = np.cumsum(value[point] * power[: len(point)], dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), total])
    hashed = mix((total[end] - total[start]) * inverse[start])
    text = np.searchsorted(ends, start, "right")
    count = np.bincount(text, minlength=len(texts))
    return Words(hashed, text, np.cumsum(count) - count, count)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each run of k words; a text of 1 to k-1 words is one run."""
    n = len(w.hash)
    if n >= k:
        at = np.flatnonzero(w.text[k - 1 :] == w.text[: n - k + 1])
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h += w.hash[at + j] * ODD[j]
        found = mix(h), w.text[at], at
    else:
        found = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if not len(short):
        return found
    h = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = w.count[short] > j
        h[has] += w.hash[w.first[short[has]] + j] * ODD[j]
    extra = mix(h + w.count[short].astype(np.uint64) * ODD[k]), short, w.first[short]
    return tuple(np.concatenate(x) for x in zip(found, extra, strict=True))


def run_hashes(w: Words, text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash, never 0, of the ``size`` words from each place of a text on; 0 where it has fewer."""
    power, inverse = _powers(len(w.hash) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * power[: len(w.hash)], dtype=np.uint64)])
    inside = at + size <= w.first[text] + w.count[text]
    found = np.zeros(len(at), np.uint64)
    first = at[inside]
    found[inside] = mix((total[first + size] - total[first]) * inverse[first]) | np.uint64(1)
    return found


def counted(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order with their counts; the hash keeps 47 bits."""
    key = np.sort((text.astype(np.uint64) << np.uint64(47)) | (h >> np.uint64(17)))
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    n = np.diff(new, append=len(key))
    return key[new] & np.uint64((1 << 47) - 1), (key[new] >> np.uint64(47)).astype(np.int64), n
