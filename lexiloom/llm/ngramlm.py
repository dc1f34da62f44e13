"""LM scoring with unbounded n-grams: every word is predicted from its longest context that occurs in a reference corpus.

p(word | context) = (c(context, word) + m * p1(word)) / (c(context) + m), the context being the longest run of preceding words
that occurs anywhere in the corpus (and is followed by a word there), p1 the add-one smoothed frequency of the word. A document's score is the mean
log chance of its words.

Steps
1. texts become chunks of word numbers with a dictionary of their own; equal texts of a chunk are scored once (documents) or weigh more (corpus);
2. the vocabulary is all words of the corpus, numbered by falling frequency. It stays a table: dictionaries are joined with it by word, and chunks are
   renumbered. Only the number of words of each frequency is broadcast: frequencies fall with the numbers, so it gives the times of any word. At most
   sqrt(2 * running words) different frequencies can exist;
3. the suffix array of the corpus (of its contexts, read backwards) is sharded by content: a shard holds, sorted, all corpus places whose preceding
   words begin with given words. A place of a document is sent to the one shard that has all that can match, and narrowed there word by word by binary search.
   Contexts of frequent words are spread over several shards by the word before, and counts for such a word alone come from a histogram that its
   shards share. A shard is read by several tasks where the documents are many for the corpus; each sums the counts of its documents;
4. contexts are sent with ``first`` words. Places that match in all of them, on both sides, go back to their chunks by number, and are sent again with
   ``wider`` times as many words, until none matches in full. So contexts are unbounded, and only waiting places are sent again.

A task streams the documents' blocks past the sorted shard, so its memory is that of a shard (SHARD_WORDS at most on average) and a block.

Defined results
* null or empty text, or text without words: n_words 0, log_prob null. Null doc_id and repeated rows: row by row.
* null or empty texts of the corpus add nothing; an empty corpus gives every word p1 = 1 / (vocabulary + 1), vocabulary being 0.
* a word that the corpus lacks has the add-one chance of one unseen word, and never matches in a context.
* equally frequent words are numbered by hash. Contexts don't cross documents. Only doc_id and text are read; empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import cut, partitions, release, remote, slim

FIRST, WIDER, SMOOTH = 3, 2, 1.0
CHUNK_WORDS, CHUNK_DOCS, SHARD_WORDS = 1_200_000, 200_000, 2_000_000
CORPUS, HISTOGRAM, QUERY = 0, 1, 2  # in this order within a shard
PART_WORDS = 2_000_000  # words of dictionaries that are looked up by one task
UNIT = 1e7  # sums of log chances travel as whole numbers
CHUNKS = "kind int, chunk long, n_texts long, n_words long, tokens binary, docs binary, words binary, times binary"
ASKED = "part int, kind int, chunk long, words binary, ids binary"
ASKED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])
CHUNKS_ARROW = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("chunk", "n_texts", "n_words")], *[(c, pa.binary()) for c in ("tokens", "docs", "words", "times")]])
NUMBERED = "kind int, chunk long, tokens binary, docs binary"
SENT = "slot int, kind int, chunk long, block binary"
SENT_ARROW = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary())])
OUT = "kind int, chunk long, sums binary, waits binary"
OUT_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("sums", pa.binary()), ("waits", pa.binary())])
LEAD = 3  # columns before a block's context: place, text (documents) or weight (corpus), next word
_codec = None


def codec():
    global _codec
    _codec = _codec or pa.Codec("zstd", compression_level=1)
    return _codec


def squeeze(x: np.ndarray) -> bytes:
    """Numbers by byte planes, of which the upper ones are nearly all zero."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(4, "little") + codec().compress(raw, asbytes=True)


def expand(x: bytes, dtype=np.uint32) -> np.ndarray:
    raw = codec().decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


# ---- chunks and word numbers -----------------------------------------------------------------------


def chunked(batches, kind: int):
    """Distinct texts of a partition in chunks: numbers into the chunk's words, lengths of texts, and which documents have them."""
    names = ("doc_id",) if kind == QUERY else ()
    part, number = TaskContext.get().partitionId(), 0
    hashes, lengths, owners, ids, seen, words = [], [], [], [], {}, 0

    def flush():
        nonlocal hashes, lengths, owners, ids, seen, words, number
        n, m = np.concatenate(lengths), len(owners)
        known, local = np.unique(np.concatenate(hashes), return_inverse=True)
        weight = np.bincount(np.array(owners, np.int64), minlength=len(n))
        times = squeeze(np.bincount(local, np.repeat(weight, n), len(known)).astype(np.int64)) if kind == CORPUS else None
        own = ids if kind == QUERY else [None] * m
        docs = np.concatenate([[len(n), m], n, owners, [i is not None for i in own], [i or 0 for i in own]]).astype(np.int64)
        yield pa.RecordBatch.from_pylist([{"kind": kind, "chunk": part << 24 | number, "n_texts": len(n), "n_words": len(known), "tokens": squeeze(local.astype(np.uint32)), "docs": squeeze(docs), "words": known.tobytes(), "times": times}], schema=CHUNKS_ARROW)
        hashes, lengths, owners, ids, seen, words, number = [], [], [], [], {}, 0, number + 1

    for texts, cols in kernel.chunks(batches, names):
        new = []
        for t in texts:
            k = seen.get(t)
            if k is None:
                k = seen[t] = len(seen)
                new.append(t)
            owners.append(k)
        ids += cols[0] if cols else []
        b = kernel.read(new)
        hashes.append(b.hashes())
        lengths.append(np.diff(b.ptr))
        words += len(b.start)
        if words > CHUNK_WORDS or len(owners) > CHUNK_DOCS:
            yield from flush()
    if owners:
        yield from flush()


class Model:
    """Times of words by number from the broadcast frequencies, and the layout of the shards."""

    def __init__(self, m: dict):
        self.first, self.n, self.total, self.size, self.shards, self.readers = m["first"], m["n"], m["total"], m["size"], m["shards"], m["readers"]

    def times(self, ids: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.zeros(len(ids), np.int64)
        at = np.maximum(np.searchsorted(self.first, ids, "right") - 1, 0)
        return np.where((ids > 0) & (ids <= self.size), self.n[at], 0)

    def single(self, ids: np.ndarray) -> np.ndarray:
        return (self.times(ids) + 1.0) / (self.total + self.size + 1)

    def spread(self, ids: np.ndarray) -> np.ndarray:
        """Over how many shards the contexts that end in a word are spread."""
        return np.clip(np.ceil(2 * self.shards * self.times(ids) / max(self.total, 1)), 1, self.shards).astype(np.uint64)

    def home(self, ids: np.ndarray) -> np.ndarray:
        return kernel.mix(ids.astype(np.uint64) + np.uint64(77)) % np.uint64(self.shards)


def word_counts(batches):
    """(word hash, times) of the corpus's chunks."""
    for batch in batches:
        for words, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(expand(times, np.int64))], ["w", "n"])


def _parts(words: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so sorted words stay in order."""
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def asked(batches, parts: int):
    """Dictionaries, or the vocabulary itself (kind -1, with numbers), by part."""
    for batch in batches:
        if batch.schema.names[0] == "w":
            w, ids = np.array(batch.column(0)).view(np.uint64), np.array(batch.column(1)).astype(np.uint32)
            rows = [(-1, 0, w[by], ids[by])] if len(by := np.argsort(w)) else []
        else:
            rows = [(k, c, np.frombuffer(w, np.uint64), None) for k, c, w in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        for kind, chunk, w, ids in rows:
            edge = np.searchsorted(_parts(w, parts), np.arange(parts + 1))
            made = [(p, kind, chunk, w[a:z].tobytes(), None if ids is None else ids[a:z].tobytes()) for p, (a, z) in enumerate(zip(edge[:-1], edge[1:])) if z > a]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), ASKED_ARROW)], schema=ASKED_ARROW)


def look_up(table: pa.Table) -> pa.Table:
    """Numbers of the words of a part, 0 for words that the corpus lacks."""
    kind, words = np.array(table.column("kind")), table.column("words").to_pylist()
    own = np.flatnonzero(kind < 0)
    known = np.concatenate([np.frombuffer(words[i], np.uint64) for i in own] or [np.zeros(0, np.uint64)])
    ids = np.concatenate([np.frombuffer(table.column("ids")[int(i)].as_py(), np.uint32) for i in own] or [np.zeros(0, np.uint32)])
    by = np.argsort(known)
    known, ids = known[by], ids[by]
    rest = np.flatnonzero(kind >= 0)
    found = []
    for i in rest:
        at, some = find(known, np.frombuffer(words[i], np.uint64))
        found.append(squeeze((ids[at] * some if len(ids) else np.zeros(len(at))).astype(np.uint32)))
    take = pa.array(rest, pa.int64())
    return pa.table([*(table.column(c).take(take) for c in ("part", "kind", "chunk")), pa.nulls(len(rest), pa.binary()), pa.array(found, pa.binary())], schema=ASKED_ARROW)


def number(table: pa.Table, model) -> pa.Table:
    """A chunk with the vocabulary's numbers, and each text's sum for the words before which the corpus has nothing to say."""
    m = Model(model.value)
    whole = next(i for i, x in enumerate(table.column("tokens").to_pylist()) if x is not None)
    row = table.slice(whole, 1).to_pylist()[0]
    answers = sorted((p, x) for p, x in zip(table.column("part").to_pylist(), table.column("ids").to_pylist()) if x is not None)
    ids = np.concatenate([expand(x) for _, x in answers] or [np.zeros(0, np.uint32)])
    ids[ids == 0] = m.size + 1
    t, docs = ids[expand(row["tokens"])], expand(row["docs"], np.int64)
    lengths = docs[2 : 2 + docs[0]]
    text, start = places(lengths)
    before = context(t, np.arange(len(t)), start, 1)
    k = (before == 0) | (before > m.size)
    base = np.bincount(text[k], np.round(-np.log(m.single(t[k])) * UNIT), len(lengths)).astype(np.int64)
    return pa.table([[row["kind"]], [row["chunk"]], [squeeze(t)], [squeeze(np.concatenate([docs, base]))]], schema=pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary())]))


def places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, where it begins) of every word."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    return text, (np.cumsum(lengths) - lengths)[text]


def context(t: np.ndarray, place: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """The k-th word before each place (k from 1), 0 where the text hasn't as many."""
    return np.where(place - k >= start, t[np.maximum(place - k, 0)], 0).astype(np.uint32) if len(t) else np.zeros(0, np.uint32)


# ---- sending places to shards ----------------------------------------------------------------------


def _blocks(kind, chunk, t, docs, at, bucket, width, m):
    """The places ``at`` with ``width`` words of context, packed by shard, as rows of SENT; the corpus goes to every reader of a shard."""
    lengths, owners = docs[2 : 2 + docs[0]], docs[2 + docs[0] : 2 + docs[0] + docs[1]]
    text, start = places(lengths)
    second = text if kind == QUERY else np.bincount(owners, minlength=len(lengths))[text]
    step = max(1_000, CHUNK_WORDS * 4 // width)
    for a in range(0, len(at), step):  # wide contexts in several pieces
        p, b = at[a : a + step], bucket[a : a + step]
        order = np.argsort(b.astype(np.uint16) if m.shards < 65536 else b, kind="stable")
        p, b = p[order], b[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(p))
        columns = [t[p], *(context(t, p, start[p], k) for k in range(1, width + 1))]
        blocks = []
        for x, z in zip(cuts[:-1], cuts[1:]):
            own = second[p[x:z]]
            blocks.append(squeeze(np.concatenate([np.diff(p[x:z], prepend=0), np.diff(own, prepend=0) if kind == QUERY else own, *(c[x:z] for c in columns)]).astype(np.uint32)))
        n, shard = len(blocks), b[cuts[:-1]].astype(np.int64)
        for reader in range(m.readers) if kind == CORPUS else [int(kernel.mix(np.array([chunk], np.uint64))[0] % np.uint64(m.readers))]:
            yield pa.RecordBatch.from_arrays([pa.array((shard * m.readers + reader).astype(np.int32)), pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(blocks, pa.binary())], schema=SENT_ARROW)


def send(batches, model, width: int):
    """All places that have a word of the corpus before them, by that word, or by the two before where it is frequent."""
    m = Model(model.value)
    for batch in batches:
        for row in range(batch.num_rows):
            kind, chunk, tokens, docs = (batch.column(c)[row].as_py() for c in range(4))
            t, docs = expand(tokens), expand(docs, np.int64)
            _, start = places(docs[2 : 2 + docs[0]])
            at = np.arange(len(t))
            c1 = context(t, at, start, 1)
            at = np.flatnonzero((c1 > 0) & (c1 <= m.size))
            c1, c2 = c1[at], context(t, at, start[at], 2)
            sub = kernel.mix(c2.astype(np.uint64) + np.uint64(991)) % m.spread(c1)
            yield from _blocks(kind, chunk, t, docs, at, (m.home(c1) + sub) % np.uint64(m.shards), width, m)


def resend(table: pa.Table, model, width: int, before: int) -> pa.Table:
    """The waiting places of a chunk with more words, by the words that matched already."""
    m = Model(model.value)
    waits = [np.cumsum(expand(x)) for x in table.column("waits").to_pylist() if x is not None]
    tokens = table.column("tokens").to_pylist()
    i = next((i for i, x in enumerate(tokens) if x is not None), None)
    if not waits or i is None:
        return SENT_ARROW.empty_table()
    t, docs = expand(tokens[i]), expand(table.column("docs")[i].as_py(), np.int64)
    _, start = places(docs[2 : 2 + docs[0]])
    at = np.unique(np.concatenate(waits)).astype(np.int64)
    h = np.zeros(len(at), np.uint64)
    for k in range(1, before + 1):
        h = h * kernel.BASE + context(t, at, start[at], k).astype(np.uint64) + np.uint64(1)
    bucket = kernel.mix(h) % np.uint64(m.shards)
    return pa.Table.from_batches(list(_blocks(table.column("kind")[i].as_py(), table.column("chunk")[i].as_py(), t, docs, at, bucket, width, m)), schema=SENT_ARROW)


def hot_pairs(batches, model):
    """(word, next word, times) in the corpus for the words that are spread over shards."""
    m = Model(model.value)
    for batch in batches:
        for row in range(batch.num_rows):
            t, docs = expand(batch.column(2)[row].as_py()), expand(batch.column(3)[row].as_py(), np.int64)
            n = docs[0]
            text, start = places(docs[2 : 2 + n])
            weight = np.bincount(docs[2 + n : 2 + n + docs[1]], minlength=n)[text]
            c1 = context(t, np.arange(len(t)), start, 1)
            k = (c1 > 0) & (m.spread(c1) > 1)
            pair, at = np.unique(c1[k].astype(np.uint64) << np.uint64(32) | t[k].astype(np.uint64), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((pair >> np.uint64(32)).astype(np.int64)), pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(np.bincount(at, weight[k], len(pair)).astype(np.int64))], ["w", "x", "n"])


def spread_histogram(table: pa.Table, model) -> pa.Table:
    """Followers of one word (those of one part), sent to all readers of each of its shards."""
    m = Model(model.value)
    w = np.array(table.column("w"))[:1]
    block = squeeze(np.concatenate([w, np.array(table.column("x")), np.array(table.column("n"))]).astype(np.uint64))
    shards = (int(m.home(w)[0]) + np.arange(int(m.spread(w)[0]))) % m.shards
    slots = (shards[:, None] * m.readers + np.arange(m.readers)).ravel().astype(np.int32)
    return pa.table([pa.array(slots), pa.array([HISTOGRAM] * len(slots), pa.int32()), pa.array([0] * len(slots), pa.int64()), pa.array([block] * len(slots), pa.binary())], schema=SENT_ARROW)


# ---- a shard ---------------------------------------------------------------------------------------


class Shard:
    """The corpus places of a shard, sorted by the words before them (the last word first)."""

    def __init__(self, blocks: list[tuple[int, bytes]], histograms: list[bytes], width: int):
        self.width, self.chunks = width, [c for c, _ in blocks]
        parts = [expand(x).reshape(LEAD + width, -1) for _, x in blocks]
        self.rows = np.array([p.shape[1] for p in parts], np.int64)
        self.places = [p[0] for p in parts]
        every = np.concatenate([p[1:] for p in parts], axis=1) if parts else np.zeros((LEAD - 1 + width, 0), np.uint32)
        del parts
        self.order = np.lexsort(every[:1:-1])
        self.weight = np.concatenate([[0], np.cumsum(every[0, self.order].astype(np.int64))])
        self.next = every[1, self.order].astype(np.uint64)
        self.runs, low = [], np.zeros(len(self.order), np.uint64)  # by depth: (key of each run of equal contexts, where it begins)
        for d in range(width):
            key = low << np.uint64(32) | every[2 + d, self.order].astype(np.uint64)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            self.runs.append((key[at], np.append(at, len(key))))
            low = np.repeat(at, np.diff(self.runs[-1][1])).astype(np.uint64)
        self.follow: dict[int, tuple] = {}
        self.full = np.zeros(len(self.runs[-1][0]), bool)  # runs that some document matches in all words
        parts = [expand(x, np.uint64) for x in histograms]
        key = np.concatenate([p[0] << np.uint64(32) | p[1 : 1 + len(p) // 2] for p in parts] or [np.zeros(0, np.uint64)])
        n = np.concatenate([p[1 + len(p) // 2 :] for p in parts] or [np.zeros(0, np.uint64)]).astype(np.int64)
        by = np.argsort(key)
        self.pairs, self.pair_times = key[by], n[by]
        self.hot, at = np.unique(self.pairs >> np.uint64(32), return_inverse=True)
        self.hot_times = np.bincount(at, self.pair_times, len(self.hot)).astype(np.int64)

    def followers(self, d: int):
        """(run and next word, times) of contexts of d words."""
        if d not in self.follow:
            start = self.runs[d - 1][1]
            key = np.repeat(start[:-1], np.diff(start)).astype(np.uint64) << np.uint64(32) | self.next
            by = np.argsort(key)
            key, total = key[by], np.concatenate([[0], np.cumsum(np.diff(self.weight)[by])])
            at = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
            self.follow[d] = key[at[:-1]], np.diff(total[at])
        return self.follow[d]

    def search(self, q: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(longest match, times of that context, times of it with the next word) for contexts q, a column for each."""
        n = q.shape[1]
        depth, run, low = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
        times, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
        on = np.arange(n)
        for d, (keys, start) in enumerate(self.runs):
            word = q[d, on].astype(np.uint64)
            at, found = find(keys, low[on] << np.uint64(32) | word)
            found &= word > 0
            on, at = on[found], at[found]
            depth[on], run[on], low[on] = d + 1, at, start[at]
            if not len(on):
                break
        self.full[run[depth == self.width]] = True
        for d in np.unique(depth[depth > 0]):
            r = np.flatnonzero(depth == d)
            start = self.runs[d - 1][1]
            a, z = start[run[r]], start[run[r] + 1]
            times[r] = self.weight[z] - self.weight[a]
            keys, n = self.followers(d)
            at, found = find(keys, a.astype(np.uint64) << np.uint64(32) | nxt[r].astype(np.uint64))
            hits[r] = np.where(found, n[at], 0) if len(n) else 0
        return depth, times, hits

    def alone(self, words: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for frequent words alone as contexts; their other shards count too."""
        w, some = find(self.hot, words.astype(np.uint64))
        at, found = find(self.pairs, words.astype(np.uint64) << np.uint64(32) | nxt.astype(np.uint64))
        if not len(self.hot):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        return some.astype(np.int64), np.where(some, self.hot_times[w], 0), np.where(found, self.pair_times[at], 0)

    def waiting(self):
        """(chunk, places) of the corpus that are in runs matched in full."""
        start = self.runs[-1][1]
        mask = np.zeros(len(self.order), bool)
        mask[self.order] = np.repeat(self.full, np.diff(start))
        edge = np.concatenate([[0], np.cumsum(self.rows)])
        for chunk, p, a, z in zip(self.chunks, self.places, edge[:-1], edge[1:]):
            if mask[a:z].any():
                yield chunk, np.cumsum(p)[mask[a:z]]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each of ``wanted`` stands in the sorted ``keys``, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def steps(at: np.ndarray) -> bytes:
    return squeeze(np.diff(at, prepend=0).astype(np.uint32))


def shard(batches, model, width: int, before: int):
    """Blocks sorted by slot, the corpus first: sums of log chances by text for the places searched, and the places to be searched further."""
    m = Model(model.value)
    slot, corpus, histograms, index, rows = None, [], [], None, []

    def out():
        nonlocal rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT_ARROW)], schema=OUT_ARROW)
        rows = []

    def close():
        if index is not None:
            rows.extend((CORPUS, chunk, None, steps(at)) for chunk, at in index.waiting())
        yield from out()

    for batch in batches:
        for i in range(batch.num_rows):
            s, kind, chunk, block = (batch.column(c)[i].as_py() for c in range(4))
            if s != slot:
                yield from close()
                slot, corpus, histograms, index = s, [], [], None
            if kind != QUERY:
                (corpus.append((chunk, block)) if kind == CORPUS else histograms.append(block))
                continue
            if index is None:
                index = Shard(corpus, histograms, width)
                corpus = histograms = None
            grid = expand(block).reshape(LEAD + width, -1)
            place, text, nxt, q = np.cumsum(grid[0].astype(np.int64)), np.cumsum(grid[1].astype(np.int64)), grid[2], grid[LEAD:]
            depth, times, hits = index.search(q, nxt)
            if not before:
                hot = np.flatnonzero((depth <= 1) & (m.spread(q[0]) > 1))
                depth[hot], times[hot], hits[hot] = index.alone(q[0, hot], nxt[hot])
            on = depth == width  # there may be more words before them that match
            single = m.single(nxt)
            lp = np.round(-np.log((hits + SMOOTH * single) / (times + SMOOTH)) * UNIT)
            lp[depth == 0] = np.round(-np.log(single[depth == 0]) * UNIT)
            k = ~on
            u, back = np.unique(text[k], return_inverse=True)
            sums = [np.diff(u, prepend=0), np.bincount(back, lp[k], len(u)), np.bincount(back, depth[k], len(u))]
            rows.append((QUERY, chunk, squeeze(np.concatenate(sums).astype(np.int64)), steps(place[on]) if on.any() else None))
            if len(rows) >= 100:
                yield from out()
    yield from close()


def finish(table: pa.Table) -> pa.Table:
    """The documents of a chunk from the sums of all shards."""
    docs = expand(next(d for d in table.column("docs").to_pylist() if d is not None), np.int64)
    n, m = docs[:2]
    lengths, owner, has, ids, base = np.split(docs[2:], np.cumsum([n, m, m, m]))
    lp, depth = base.astype(float), np.zeros(n)
    for x in table.column("sums").to_pylist():
        if x is not None:
            u, s, d = expand(x, np.int64).reshape(3, -1)
            u = np.cumsum(u)
            lp[u] += s
            depth[u] += d
    some = np.maximum(lengths, 1)
    lp, depth, none = np.round(-lp / UNIT / some, 6)[owner] + 0.0, np.round(depth / some, 6)[owner], (lengths == 0)[owner]
    return pa.table([pa.array(ids, mask=has == 0), pa.array(lengths[owner].astype(np.int32)), pa.array(lp, mask=none), pa.array(depth, mask=none)], ["doc_id", "n_words", "log_prob", "mean_context"])


# ---- plan ------------------------------------------------------------------------------------------


def vocabulary(chunks: DataFrame) -> tuple[DataFrame, dict]:
    """(w, id from 1 by falling frequency) of all words of the corpus, and the frequencies with the first number of each."""
    counts = chunks.where(F.col("kind") == CORPUS).select("words", "times").mapInArrow(remote(__name__, "word_counts"), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    ranked = cut(counts.orderBy(F.desc("n"), "w"))
    sizes = dict(map(tuple, ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()))  # one number for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offset = F.element_at(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)]), F.spark_partition_id() + 1)
    ids = ranked.select("w", (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + offset + 1).cast("long").alias("id"))
    frequencies = sorted(((r[0], r[1]) for r in ranked.groupBy("n").count().toLocalIterator()), reverse=True)
    n, words = np.array([f[0] for f in frequencies], np.int64), np.array([f[1] for f in frequencies], np.int64)
    return ids, {"n": n, "first": np.cumsum(words) - words + 1, "total": int((n * words).sum()), "size": int(words.sum())}


def score(docs: DataFrame, corpus: DataFrame, first: int = FIRST, wider: int = WIDER) -> DataFrame:
    """doc_id, n_words, log_prob (mean, natural), mean_context (mean length of the contexts matched) for every row of ``docs``; ``corpus`` has a column text."""
    spark = docs.sparkSession
    ask = lambda df, kind: df.mapInArrow(remote(__name__, "chunked", kind=kind), CHUNKS)
    chunks = cut(ask(slim(docs, "doc_id", "text"), QUERY).unionByName(ask(slim(corpus, "text").where("text is not null"), CORPUS)))
    ids, found = vocabulary(chunks)
    # a task has about four partitions' share: larger blocks, and fewer sums of one text. Readers of a shard against copies of the corpus: where both cost the same.
    tasks = max(8, partitions(spark) // 4)
    texts, words = (x or 0 for x in chunks.agg(F.sum(F.when(F.col("kind") == QUERY, F.col("n_texts"))), F.sum("n_words")).first())
    parts = max(8, math.ceil(words / PART_WORDS))
    readers = max(1, min(tasks, round(math.sqrt(1.5 * texts * tasks / max(found["total"], 1)))))
    shards = max(math.ceil(tasks / readers), math.ceil(found["total"] / SHARD_WORDS))
    model = spark.sparkContext.broadcast(found | {"shards": shards, "readers": readers})
    slots = shards * readers
    look = lambda df: df.mapInArrow(remote(__name__, "asked", parts=parts), ASKED)
    answers = look(chunks.select("kind", "chunk", "words")).unionByName(look(ids)).groupBy("part").applyInArrow(remote(__name__, "look_up"), ASKED)
    null = F.lit(None).cast("binary")
    answers = answers.select("kind", "chunk", "part", "ids", null.alias("tokens"), null.alias("docs"))
    whole = chunks.select("kind", "chunk", F.lit(-1).alias("part"), null.alias("ids"), "tokens", "docs")
    numbered = cut(answers.unionByName(whole).groupBy("kind", "chunk").applyInArrow(remote(__name__, "number", model=model), NUMBERED))
    del chunks, ids, answers, whole
    release(spark)
    pairs = numbered.where(F.col("kind") == CORPUS).mapInArrow(remote(__name__, "hot_pairs", model=model), "w long, x long, n long").groupBy("w", "x").agg(F.sum("n").alias("n"))
    extra = pairs.groupBy("w", (F.col("x") % 64).alias("part")).applyInArrow(remote(__name__, "spread_histogram", model=model), SENT)
    sent = numbered.mapInArrow(remote(__name__, "send", model=model, width=first), SENT).unionByName(extra)
    sums, width, before = None, first, 0
    while True:
        by_slot = sent.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "kind")
        out = cut(by_slot.mapInArrow(remote(__name__, "shard", model=model, width=width, before=before), OUT))
        del sent, by_slot
        release(spark)
        part = out.where("sums is not null").select("chunk", "sums")
        sums = part if sums is None else sums.unionByName(part)
        waits = out.where("waits is not null").select("kind", "chunk", "waits", null.alias("tokens"), null.alias("docs"))
        if waits.isEmpty():
            break
        width, before = width * wider, width
        back = waits.unionByName(numbered.select("kind", "chunk", null.alias("waits"), "tokens", "docs"))
        sent = back.groupBy("kind", "chunk").applyInArrow(remote(__name__, "resend", model=model, width=width, before=before), SENT)
    named = numbered.where(F.col("kind") == QUERY).select("chunk", "docs", null.alias("sums"))
    every = named.unionByName(sums.select("chunk", null.alias("docs"), "sums"))
    return every.groupBy("chunk").applyInArrow(remote(__name__, "finish"), "doc_id long, n_words int, log_prob double, mean_context double")
