"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Normal form: words (runs of letters, digits and marks) in lower case, known by 64-bit hashes and numbered by the items' own words. The
automaton's symbols are words: blocks of half a ``window`` at such a stride that every window of an item has a whole one. Where a block is met, the match is
extended to both sides, and it counts if it has ``window`` words (or the whole of a shorter item). So the automaton has less than one node for
a word of the benchmark, and one scan does whatever the benchmark's size. It passes over places where two words follow each other that do so
in no block. Offsets are those of the original text.

Defined results
* null or empty text, text without words: no span. Null doc_id: its spans carry a null doc_id.
* items that are null, or have fewer than ``min_words`` words, are no patterns (a one-word answer would match everywhere).
* equal items: a span for each of them. Repeated documents: spans for each row. An item that repeats itself may lie over a
  text in several ways; its spans may overlap then, but none comes twice.
* an empty benchmark or empty documents: no rows. Other columns are never read.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel
from .common import remote, slim

WINDOW, MIN_WORDS = 8, 4
SCHEMA = "doc_id long, item_id long, start_char int, end_char int, n_words int, item_words int"
_built: dict = {}


class Automaton:
    """Words of the items by number, the items as numbers, and the automaton over their blocks (item, first word)."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, min_words: int):
        import ahocorasick

        b = kernel.read([t or "" for _, t in items])
        h = b.hashes()
        self.known = np.unique(h)
        number = np.searchsorted(self.known, h) + 1
        self.items = [(i, number[a:z]) for (i, _), a, z in zip(items, b.ptr[:-1], b.ptr[1:]) if z - a >= max(min_words, 1)]
        self.window, block = window, (window + 1) // 2
        where: dict[tuple, list] = {}
        for x, (_, w) in enumerate(self.items):
            n = min(block, len(w))
            for k in range(0, len(w) - n + 1, window - block + 1) if len(w) > window else (0,):
                where.setdefault(tuple(w[k : k + n].tolist()), []).append((x, k))
        self.blocks = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, v in where.items():
            self.blocks.add_word(key, (len(key), v))
        self.least = min(map(len, where), default=0)
        self.pairs = np.unique(np.array([a << 32 | b for key in where for a, b in zip(key, key[1:])], np.uint64))
        if where:
            self.blocks.make_automaton()

    def __len__(self) -> int:
        return len(self.items)

    def numbers(self, b: kernel.Batch) -> np.ndarray:
        h = b.hashes()
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at + 1, 0)

    def runs(self, b: kernel.Batch):
        """(text, item, first word, words) of the longest runs that lie over an item."""
        t = self.numbers(b)
        seen: dict[tuple[int, int, int], int] = {}  # (text, item, where the item would begin): end of its last run
        given: set[tuple] = set()
        for first, upto in self.stretches(t, b.ptr):
            d = int(np.searchsorted(b.ptr, first, "right")) - 1
            a, z = int(b.ptr[d]), int(b.ptr[d + 1])
            for last, (n, found) in self.blocks.iter(tuple(t[first:upto].tolist())):
                w = first + last - n + 1
                for x, k in found:
                    if w < seen.get((a, x, w - k), 0):
                        continue
                    item = self.items[x][1]
                    low = min(k, w - a)
                    back = np.flatnonzero(item[k - low : k] != t[w - low : w])
                    begin = w - low + (int(back[-1]) + 1 if len(back) else 0)
                    high = min(len(item) - k, z - w)
                    ahead = np.flatnonzero(item[k : k + high] != t[w : w + high])
                    end = w + (int(ahead[0]) if len(ahead) else high)
                    seen[a, x, w - k] = end
                    if end - begin >= min(self.window, len(item)) and (x, begin, end) not in given:
                        given.add((x, begin, end))
                        yield a, x, begin, end - begin

    def stretches(self, t: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int]]:
        """Where a block can be: runs of words each two of which follow each other in some block, within a text."""
        if self.least < 2:
            return [(a, z) for a, z in zip(ptr[:-1].tolist(), ptr[1:].tolist()) if z > a]
        pair = t[:-1].astype(np.uint64) << np.uint64(32) | t[1:].astype(np.uint64)
        ok = np.zeros(len(t) + 1, np.int8)
        at = np.flatnonzero((t[:-1] > 0) & (t[1:] > 0))
        ok[at + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)] == pair[at]
        ok[ptr[(ptr < len(t))]] = 0  # ok[i]: words i - 1 and i of one text
        step = np.diff(ok, append=np.int8(0))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
        long = end - begin >= self.least
        return list(zip(begin[long].tolist(), end[long].tolist()))


def automaton(items, window: int, min_words: int, key: str) -> Automaton:
    """Built once for each worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items.value, window, min_words)
    return _built[key]


def spans(b: kernel.Batch, auto: Automaton, ids) -> list[tuple]:
    rows = []
    for a, x, first, n in auto.runs(b):
        d = int(np.searchsorted(b.ptr, a, "right")) - 1
        item, words = auto.items[x]
        rows.append((ids[d], item, int(b.start[first] - b.at[d]), int(b.end[first + n - 1] - b.at[d]), n, len(words)))
    return rows


def scan(batches, items, window: int, min_words: int, key: str):
    """Spans of a partition's texts."""
    auto = automaton(items, window, min_words, key)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in ("start_char", "end_char", "n_words", "item_words")]])
    for texts, (ids,) in kernel.chunks(batches, ("doc_id",)):
        rows = spans(kernel.read(texts), auto, ids) if len(auto) else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def filter_rows(batches, items, window: int, min_words: int, key: str):
    auto = automaton(items, window, min_words, key)
    for b in batches:
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        keep = np.ones(len(texts), bool)
        if len(auto):
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)))], ["text", "row"])
            for part, (rows,) in kernel.chunks([whole], ("row",)):
                for r in spans(kernel.read(part), auto, rows):
                    keep[r[0]] = False
        if keep.any():
            yield b.filter(pa.array(keep))


def _shared(docs: DataFrame, benchmark: DataFrame):
    """The test items as a broadcast variable; their number does not follow the corpus."""
    rows = slim(benchmark, "item_id", "text").where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator()
    return docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in rows])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of ``docs`` (doc_id, text) that repeat ``benchmark`` (item_id, text): doc_id, item_id, start_char, end_char, n_words, item_words."""
    source = slim(docs, "doc_id", "text").where("text is not null")
    return source.mapInArrow(remote(__name__, "scan", items=_shared(docs, benchmark), window=window, min_words=min_words, key=uuid4().hex), SCHEMA)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows whose text repeats a test item (a run of ``window`` words, or a whole shorter item).

    Decided row by row in one scan: no join back. All columns stay, and rows with null text stay.
    """
    return docs.mapInArrow(remote(__name__, "filter_rows", items=_shared(docs, benchmark), window=window, min_words=min_words, key=uuid4().hex), docs.schema)
