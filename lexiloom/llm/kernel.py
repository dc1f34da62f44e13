"""Vectorised text kernel: words, their hashes and n-gram sets for many documents at once.

A batch of texts becomes one array of code points. Words are maximal runs of letters, digits and
marks, lower-cased by a one-to-one table, so every word keeps its exact offsets in the original
text. Word hashes come from one prefix sum over the batch (a polynomial modulo 2**64 with random
character values), hence cost does not depend on the number of words.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
CHUNK_CHARS, CHUNK_TEXTS = 1_000_000, 5_000


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a word character, lower case) by code point; built once for each worker."""
    if "word" not in _tables:
        n = 0x110000
        word, lower = np.zeros(n, np.bool_), np.arange(n, dtype=np.uint32)
        for c in range(n):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            if x.isalnum() or (c > 0x2FF and unicodedata.category(x)[0] == "M"):
                word[c] = True
                if x != (y := x.lower()) and len(y) == 1:
                    lower[c] = ord(y)
        _tables["word"], _tables["lower"] = word, lower
    return _tables["word"], _tables["lower"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        n = max(n, CHUNK_CHARS + 200_000)
        for name, b in (("pow", BASE), ("inv", BASE_INV)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _tables[name] = np.cumprod(a, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _values() -> np.ndarray:
    if "val" not in _tables:
        _tables["val"] = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _tables["val"]


@dataclass
class Batch:
    """Code points of texts joined by newlines; ``at[i]`` is where text i begins, ``at[-1]`` the end."""

    cps: np.ndarray
    low: np.ndarray
    at: np.ndarray
    start: np.ndarray  # of each word, in cps
    end: np.ndarray
    ptr: np.ndarray  # words of text i: ptr[i]:ptr[i + 1]

    @property
    def docs(self) -> int:
        return len(self.at) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.ptr))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, the same in every batch."""
        power, inverse = _powers(len(self.cps) + 1)
        total = np.zeros(len(self.cps) + 1, np.uint64)
        np.cumsum(_values()[self.low] * power[: len(self.cps)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])


def read(texts: list[str]) -> Batch:
    word, lower = tables()
    raw = "\n".join(texts) + "\n" if texts else ""
    cps = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=at[1:])
    is_word = word[cps]
    step = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Batch(cps, lower[cps], at, start, end, np.searchsorted(start, at))


def chunks(batches, columns: tuple[str, ...], text: str = "text", chars: int = CHUNK_CHARS):
    """Arrow batches as lists of (texts, other columns as lists), each of about ``chars`` characters and CHUNK_TEXTS texts at most; null texts become ''."""
    kept: list[list] = [[] for _ in columns]
    texts: list[str] = []
    size = 0
    for whole in batches:
        for first in range(0, whole.num_rows, 500):  # few texts at a time as Python strings
            b = whole.slice(first, 500)
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]
            for i, t in enumerate(b.column(b.schema.get_field_index(text)).to_pylist()):
                t = t or ""
                if texts and (size + len(t) > chars or len(texts) >= CHUNK_TEXTS):
                    yield texts, kept
                    kept, texts, size = [[] for _ in columns], [], 0
                texts.append(t)
                size += len(t) + 1
                for k, c in zip(kept, cols):
                    k.append(c[i])
    if texts:
        yield texts, kept


def shingle_sets(b: Batch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, pointers): the distinct word n-grams of each text, sorted; a text of 1 to n - 1 words has one, of all its words."""
    h = b.hashes()
    count = np.diff(b.ptr)
    m = len(h)
    grams = np.zeros(m, np.uint64)
    if m >= n:
        width = m - n + 1
        acc = np.zeros(width, np.uint64)
        for k in range(n):
            acc = acc * BASE + h[k : k + width]
        grams[:width] = mix(acc)
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    for i in np.flatnonzero((count > 0) & (count < n)):
        acc = np.uint64(count[i])
        with np.errstate(over="ignore"):
            for x in h[b.ptr[i] : b.ptr[i + 1]]:
                acc = acc * BASE + x
        grams[b.ptr[i]] = mix(np.array([acc], np.uint64))[0]
    ptr = np.zeros(len(count) + 1, np.int64)
    np.cumsum(sizes, out=ptr[1:])
    out = grams[ranges(b.ptr[:-1], sizes)]
    for i in range(len(count)):
        out[ptr[i] : ptr[i + 1]].sort()
    keep = np.ones(len(out), np.bool_)
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[ptr[:-1][sizes > 0]] = True
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[ptr]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, joined."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)
