"""Quality classifier: a generalised additive model with pairwise interactions.

Two models of one kind, for "good" and for "toxic", are fitted on a bounded sample of labelled rows
(SAMPLE rows, the first in a hashed order of doc_id). Boosting goes round the features in turn, each time adding a
shallow tree on one feature's bins, then round the strongest pairs. What is left is a lookup table for each
feature and pair, so scoring is adding table entries. Three of the features come from a list of words and
beginnings of words with log odds for the two labels, learned on one half of the sample; the models are fitted on the other half.

A document is kept where its quality is at least ``cut`` and its toxicity less than ``toxic_cut``.

Defined results
* null or empty text: scored like any text, by features that are all zero.
* labels: several rows for a doc_id count as one (greatest quality, greatest toxic); of a doc_id that has several texts the smallest is
  learned from; null labels are left out; no labels at all,
  or one class only: that model gives its class's share for every document (good 1.0, toxic 0.0 if there is no label), so all are kept.
* null doc_id, repeated rows: scored row by row. Empty documents: no rows. Other columns never meet the model's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import cut as checkpointed
from .common import remote, slim

SAMPLE, MIN_DOCS = 8_000, 4
STEMS = (6, 8)
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 64, 16, 8, 150, 60, 0.1
CUT, TOXIC_CUT = 0.5, 0.5
FEATURES = ("words", "word_length", "upper", "symbols", "digits", "distinct", "short", "line_repeats", "line_length", "touching_symbols", "top_word", "good_words", "toxic_words", "toxic_best")
SCORED = "doc_id long, quality_score double, toxic_score double, keep boolean"


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = kernel._tables
    if "upper" not in t:
        n = 0x110000
        up, space, digit = (np.zeros(n, np.bool_) for _ in range(3))
        for c in range(0x3000):
            up[c], space[c], digit[c] = chr(c).isupper(), chr(c).isspace(), chr(c).isdigit()
        space[0x3000] = True
        t["upper"], t["space"], t["digit"] = up, space, digit
    return t["upper"], t["space"], t["digit"]


def pieces(b: kernel.Batch, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts): words, and the beginnings of longer ones, so that inflected forms that were never seen are known by their stems."""
    doc, length = b.doc_of_word(), b.end - b.start
    hashes, docs = [h], [doc]
    for n in STEMS:
        k = np.flatnonzero(length > n)
        cut = kernel.Batch(b.cps, b.low, b.at, b.start[k], b.start[k] + n, b.ptr)
        hashes.append(kernel.mix(cut.hashes() ^ np.uint64(n)))
        docs.append(doc[k])
    return np.concatenate(hashes), np.concatenate(docs)


def features(texts: list[str], lexicon: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """One row for each text, whole texts."""
    b = kernel.read(texts)
    n = b.docs
    upper, space, digit = _classes()
    word = kernel.tables()[0]

    def per_doc(flags) -> np.ndarray:
        total = np.zeros(len(b.cps) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[b.at[1:]] - total[b.at[:-1]]).astype(float)

    chars = (np.diff(b.at) - 1).astype(float)
    spaces = per_doc(space[b.cps]) - 1
    ink = np.maximum(chars - spaces, 1)
    is_word = word[b.cps]
    words = np.diff(b.ptr).astype(float)
    some = np.maximum(words, 1)
    h = b.hashes()
    doc = b.doc_of_word()
    length = (b.end - b.start).astype(float)
    by = lambda x: np.bincount(doc, x, n)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(words)
    out[:, 1] = by(length) / some
    out[:, 2] = per_doc(upper[b.cps]) / ink
    out[:, 3] = (chars - spaces - per_doc(is_word)) / ink
    out[:, 4] = per_doc(digit[b.cps]) / ink
    out[:, 6] = by(length <= 3) / some
    for i in range(n):  # distinct words and the commonest one
        a, z = b.ptr[i], b.ptr[i + 1]
        if z > a:
            x = np.sort(h[a:z])
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            out[i, 5], out[i, 10] = (len(edge) - 1) / (z - a), np.diff(edge).max() / (z - a)
    lines = [[x for x in t.split("\n") if x] for t in texts]
    k = np.array([len(x) for x in lines], float)
    out[:, 7] = [1 - len(set(x)) / len(x) if x else 0.0 for x in lines]
    out[:, 8] = np.log1p(words / np.maximum(k, 1))
    if len(b.end):
        after = b.cps[np.minimum(b.end, len(b.cps) - 1)]
        out[:, 9] = by(~space[after] & ~np.isin(after, [44, 46])) / some
    known, good, toxic = lexicon
    if len(known) and len(h):
        p, owner = pieces(b, h)
        at = np.minimum(np.searchsorted(known, p), len(known) - 1)
        hit = known[at] == p
        at, owner = at[hit], owner[hit]
        out[:, 11] = np.bincount(owner, good[at], n) / some
        odds = np.maximum(toxic[at], 0.0)
        out[:, 12] = np.bincount(owner, odds, n) / some
        best = np.zeros(n)
        np.maximum.at(best, owner, odds)
        out[:, 13] = best
    out[words == 0] = 0.0
    return out


# ---- fitting, on the driver, on the bounded sample -------------------------------------------------


def _tree(g: np.ndarray, w: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a shallow tree that fits gradients ``g`` with weights ``w`` (sums by bin)."""
    G, W = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(w)])
    gain = lambda a, z: (G[z] - G[a]) ** 2 / (W[z] - W[a] + 1.0)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for k, (a, z) in enumerate(parts):
            m = np.arange(a + 1, z)
            if len(m):
                v = gain(a, m) + gain(m, z) - gain(a, z)
                j = int(v.argmax())
                best = max(best, (float(v[j]), (k, int(m[j]))), key=lambda x: x[0])
        if best[1] is None:
            break
        k, m = best[1]
        a, z = parts.pop(k)
        parts += [(a, m), (m, z)]
    out = np.zeros(len(g))
    for a, z in parts:
        out[a:z] = (G[z] - G[a]) / (W[z] - W[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best cross of one cut on each side (four leaves), and its gain."""
    G, W = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, w))
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    quads = lambda S: (S[a, b], S[a, -1] - S[a, b], S[-1, b] - S[a, b], S[-1, -1] - S[a, -1] - S[-1, b] + S[a, b])
    total = sum(x**2 / (y + 1.0) for x, y in zip(quads(G), quads(W)))
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    out = np.zeros(g.shape)
    for k, (r, c) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[r, c] = quads(G)[k][i, j] / (quads(W)[k][i, j] + 1.0)
    return out, float(total[i, j] - G[-1, -1] ** 2 / (W[-1, -1] + 1.0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(X: np.ndarray, y: np.ndarray) -> dict:
    """Bin edges, a table for each feature, and tables for the strongest pairs."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return {"base": float(np.log(p / (1 - p))), "edges": [], "tables": [], "pairs": [], "pair_tables": []}
    d = X.shape[1]
    edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    bins = [np.searchsorted(e, X[:, j], "right") for j, e in enumerate(edges)]
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    score = np.full(len(y), base)
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(ROUNDS):
        for j in range(d):
            q = sigmoid(score)
            step = RATE * _tree(np.bincount(bins[j], y - q, len(tables[j])), np.bincount(bins[j], q * (1 - q), len(tables[j])))
            tables[j] += step
            score += step[bins[j]]
    coarse = [np.minimum(b * PAIR_BINS // max(1, len(t)), PAIR_BINS - 1) for b, t in zip(bins, tables)]
    q = sigmoid(score)
    grid = lambda i, j, x: np.bincount(coarse[i] * PAIR_BINS + coarse[j], x, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    ranked = sorted(((-_pair_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)))[1], i, j) for i in range(d) for j in range(i + 1, d)))
    pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            q = sigmoid(score)
            step = RATE * _pair_tree(grid(i, j, y - q), grid(i, j, q * (1 - q)))[0]
            pair_tables[k] += step
            score += step[coarse[i], coarse[j]]
    return {"base": base, "edges": edges, "tables": tables, "pairs": pairs, "pair_tables": pair_tables}


def predict(model: dict, X: np.ndarray) -> np.ndarray:
    score = np.full(len(X), model["base"])
    bins = [np.searchsorted(e, X[:, j], "right") for j, e in enumerate(model["edges"])]
    for b, t in zip(bins, model["tables"]):
        score += t[b]
    coarse = [np.minimum(b * PAIR_BINS // max(1, len(t)), PAIR_BINS - 1) for b, t in zip(bins, model["tables"])]
    for (i, j), t in zip(model["pairs"], model["pair_tables"]):
        score += t[coarse[i], coarse[j]]
    return sigmoid(score)


# ---- on executors ----------------------------------------------------------------------------------


def word_counts(batches):
    """(word hash, documents, good ones, toxic ones) of a partition of the sample."""
    schema = pa.schema([("w", pa.int64()), ("n", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])
    for texts, (quality, toxic) in kernel.chunks(batches, ("quality", "toxic")):
        b = kernel.read(texts)
        h, doc = pieces(b, b.hashes())
        pair = np.unique(np.stack([h.view(np.int64), doc]), axis=1)
        w, at = np.unique(pair[0], return_inverse=True)
        q, t = np.array(quality, float), np.array(toxic, float)
        yield pa.RecordBatch.from_arrays([pa.array(w), *(pa.array(np.bincount(at, x[pair[1]], len(w)).astype(np.int64)) for x in (np.ones(len(texts)), q, t))], schema=schema)


def sample_features(batches, lexicon):
    for texts, (ids, quality, toxic) in kernel.chunks(batches, ("doc_id", "quality", "toxic")):
        X = features(texts, lexicon.value)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(quality, pa.int32()), pa.array(toxic, pa.int32()), pa.array(list(X), pa.list_(pa.float64()))], ["doc_id", "quality", "toxic", "x"])


def scores(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    X = features(texts, model["lexicon"])
    q, t = np.round(predict(model["good"], X), 6), np.round(predict(model["toxic"], X), 6)
    return q, t, (q >= model["cut"]) & (t < model["toxic_cut"])


def score_rows(batches, model):
    for texts, (ids,) in kernel.chunks(batches, ("doc_id",)):
        q, t, keep = scores(texts, model.value)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(q), pa.array(t), pa.array(keep)], ["doc_id", "quality_score", "toxic_score", "keep"])


def kept_rows(batches, model):
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        keep = np.concatenate([scores(part, model.value)[2] for part, _ in kernel.chunks([pa.RecordBatch.from_arrays([texts], ["text"])], ())] or [np.zeros(0, bool)])
        if keep.any():
            yield b.filter(pa.array(keep))


# ---- plans -----------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT, toxic_cut: float = TOXIC_CUT) -> dict:
    """Fit on at most ``sample`` labelled documents: what reaches the driver is their features, and the words that MIN_DOCS of them have."""
    spark = docs.sparkSession
    some = slim(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, quality int, toxic int")
    texts = slim(docs, "doc_id", "text").where("text is not null").join(F.broadcast(rows), "doc_id")  # at most `sample` rows of 16 bytes
    texts = checkpointed(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    counts = texts.where(half == 0).mapInArrow(remote(__name__, "word_counts"), "w long, n long, good long, toxic long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    n, good, toxic = texts.where(half == 0).agg(F.count("*"), F.sum("quality"), F.sum("toxic")).first()
    g, t = (good or 0, toxic or 0)
    odds = lambda c, k: F.log((F.col(c) + 0.5) / (k + 1.0)) - F.log((F.col("n") - F.col(c) + 0.5) / (n - k + 1.0))
    words = counts.where(F.col("n") >= MIN_DOCS).select("w", F.round(odds("good", g), 6).alias("g"), F.round(odds("toxic", t), 6).alias("t"))
    top = sorted(tuple(r) for r in words.toLocalIterator())
    known = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    lexicon = (known[order], np.array([r[1] for r in top], float)[order], np.array([r[2] for r in top], float)[order])
    shared = spark.sparkContext.broadcast(lexicon)
    rows = sorted((tuple(r) for r in texts.where(half == 1).mapInArrow(remote(__name__, "sample_features", lexicon=shared), "doc_id long, quality int, toxic int, x array<double>").collect()), key=lambda r: r[0])
    X = np.array([r[3] for r in rows], float).reshape(len(rows), len(FEATURES))
    y, z = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    return {"good": fit(X, y) if len(y) else fit(X, np.ones(1)), "toxic": fit(X, z) if len(z) else fit(X, np.zeros(1)), "lexicon": lexicon, "cut": cut, "toxic_cut": toxic_cut}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, quality_score, toxic_score, keep for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return slim(docs, "doc_id", "text").mapInArrow(remote(__name__, "score_rows", model=shared), SCORED)


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns; decided in one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(remote(__name__, "kept_rows", model=shared), docs.schema)
