"""Language identification in two steps: the language family first, then one-versus-one linear SVMs among the family's languages.

Features are relative frequencies (square roots) of hashed character 1- to 3-grams of the whole text in lower case, words
being set apart by one boundary character. The models are fitted on at most SAMPLE labelled rows, the first in a hashed order of doc_id.

Defined results
* text that is null, empty or without letters: family and language are null, margin is 0.
* rows with a null label are not learned from; of a doc_id that has several texts the smallest is learned from; no labelled row at all: every language is null; one language only: it is given to every text.
* ties of votes go to the larger sum of margins, then to the alphabetically first language. Null doc_id and repeated rows: row by row.
* empty input: no rows. Only doc_id, text and (for fitting) the label are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import remote, slim

SAMPLE, DIMS, REG, STEPS, TEXTS = 4_000, 2_048, 1e-4, 150, 500
FAMILIES = {
    "germanic": "af da de en fo fy is lb nds nl no nb nn sv yi", "romance": "an ast ca es fr gl it la lmo oc pms pt ro scn wa", "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "celtic": "br cy ga gd", "baltic": "lt lv", "uralic": "et fi hu", "turkic": "az ba kk ky tr tt ug uz", "indo-aryan": "as bn gu hi mr ne or pa si sa ur", "dravidian": "kn ml ta te",
    "semitic": "am ar arz he mt", "iranian": "ckb fa ku ps tg", "bantu": "ig ny rn rw sn st sw tn ts xh yo zu", "austronesian": "ceb id jv mg ms su tl", "sinitic": "zh yue wuu",
}
FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs.split()}
SCHEMA = "doc_id long, family string, language string, margin double"


def features(texts: list[str], dims: int = DIMS) -> np.ndarray:
    b = kernel.read(texts)
    n = b.docs
    lengths = b.end - b.start + 1
    norm = b.low[kernel.ranges(b.start, lengths)].astype(np.uint32)
    if not len(norm):
        return np.zeros((n, dims), np.float32)
    norm[np.cumsum(lengths) - 1] = 32
    doc = np.repeat(b.doc_of_word(), lengths)
    out = np.zeros(n * dims)
    h = np.zeros(len(norm), np.uint32)
    for k in range(3):
        m = len(norm) - k
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + norm[k:] * np.uint32(0x9E3779B1) + np.uint32(k + 1)
        same = doc[:m] == doc[k:]
        place = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(21)) % np.uint32(dims)
        out += np.bincount((doc[:m] * dims + place)[same], minlength=n * dims)
    out = np.sqrt(out).reshape(n, dims)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def svm(X: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss; accelerated gradient on the whole sample, classes balanced."""
    Z = np.hstack([X, np.ones((len(X), 1))]).astype(np.float32)
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    w = v = np.zeros(Z.shape[1], np.float32)
    rate = np.float32(0.25)
    for k in range(STEPS):
        slack = np.maximum(0, 1 - y * (Z @ v))
        step = v - rate * (np.float32(REG) * v - 2 * ((c * y * slack) @ Z))
        v = step + np.float32(k / (k + 3)) * (step - w)
        w = step
    return w.astype(float)


def models(labels: list[str]) -> list[tuple[str, str | None]]:
    """Of each model what it tells apart: two languages of a family, or (f, None) a family from the others; one of two families is enough."""
    langs = sorted(set(labels))
    kinds = sorted({FAMILY.get(x, x) for x in langs})
    return [(f, None) for f in (kinds[:1] if len(kinds) == 2 else kinds if len(kinds) > 2 else [])] + [(a, b) for a, b in combinations(langs, 2) if FAMILY.get(a, a) == FAMILY.get(b, b)]


def fit_one(X: np.ndarray, labels: list[str], a: str, b: str | None) -> np.ndarray:
    lab = np.array(labels)
    if b is None:
        return svm(X, np.where(np.array([FAMILY.get(x, x) for x in labels]) == a, 1.0, -1.0))
    k = (lab == a) | (lab == b)
    return svm(X[k], np.where(lab[k] == a, 1.0, -1.0))


def assemble(labels: list[str], weights: dict) -> dict:
    langs = sorted(set(labels))
    kinds = sorted({FAMILY.get(x, x) for x in langs})
    first = {a: w for (a, b), w in weights.items() if b is None}
    if len(first) == 1:
        first[kinds[1]] = -first[kinds[0]]
    return {"kinds": kinds, "first": first, "pairs": {k: w for k, w in weights.items() if k[1] is not None}, "langs": {f: [x for x in langs if FAMILY.get(x, x) == f] for f in kinds}}


def fit(X: np.ndarray, labels: list[str]) -> dict:
    return assemble(labels, {(a, b): fit_one(X, labels, a, b) for a, b in models(labels)})


def predict(model: dict, X: np.ndarray) -> tuple[list, list, np.ndarray]:
    """(families, languages, margins): the margin is the smaller of the two steps' leads, 6 digits."""
    n = len(X)
    families, languages, margin = [None] * n, [None] * n, np.zeros(n)
    some = X.any(axis=1)
    if not model["kinds"]:
        return families, languages, margin
    Z = np.hstack([X, np.ones((n, 1), np.float32)]).astype(float)
    if model["first"]:
        s = np.stack([Z @ model["first"][f] for f in model["kinds"]], axis=1)
        kind = s.argmax(axis=1)
        top = np.sort(s, axis=1)
        lead = top[:, -1] - top[:, -2]
    else:
        kind, lead = np.zeros(n, int), np.full(n, np.inf)
    for f, name in enumerate(model["kinds"]):
        langs = model["langs"][name]
        rows = np.flatnonzero((kind == f) & some)
        votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
        for i, j in combinations(range(len(langs)), 2):
            m = Z[rows] @ model["pairs"][langs[i], langs[j]]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
        order = np.lexsort((np.broadcast_to(np.arange(len(langs)), votes.shape), -sums, -votes))
        for r, o in zip(rows, order):
            families[r], languages[r] = name, langs[o[0]]
        if len(langs) > 1 and len(rows):
            lead[rows] = np.minimum(lead[rows], np.take_along_axis(sums, order[:, :1], 1)[:, 0])
    margin[some] = np.where(np.isfinite(lead[some]), lead[some], 0.0)
    return families, languages, np.round(margin, 6)


def slices(batches, columns: tuple[str, ...]):
    """Few texts at a time: each has a dense row of features."""
    for texts, cols in kernel.chunks(batches, columns):
        for k in range(0, len(texts), TEXTS):
            yield texts[k : k + TEXTS], [c[k : k + TEXTS] for c in cols]


def sample_features(batches):
    for texts, (ids, langs) in slices(batches, ("doc_id", "lang")):
        X = features(texts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array([x.tobytes() for x in X], pa.binary())], ["doc_id", "lang", "x"])


def fit_rows(batches, sample):
    X, labels = sample.value
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fit_one(X, labels, x, y).tobytes() for x, y in zip(a, b)], pa.binary())], ["a", "b", "w"])


def label_rows(batches, model):
    for texts, (ids,) in slices(batches, ("doc_id",)):
        f, lang, m = predict(model.value, features(texts))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f, pa.string()), pa.array(lang, pa.string()), pa.array(m)], ["doc_id", "family", "language", "margin"])


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` documents of ``docs`` that have a label; their features (8 kB each) go to the driver, and to the tasks that fit."""
    spark = docs.sparkSession
    known = docs.select("doc_id", F.col("text"), F.col(f"`{label}`").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null")
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    ids = spark.createDataFrame([(r[0],) for r in chosen], "doc_id long")
    texts = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "d.text", "d.lang")  # at most `sample` rows of 8 bytes
    rows = sorted((r[0], r[1], bytes(r[2])) for r in texts.mapInArrow(remote(__name__, "sample_features"), "doc_id long, lang string, x binary").toLocalIterator())
    X, labels = np.stack([np.frombuffer(r[2], np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32), [r[1] for r in rows]
    wanted = models(labels)
    if not wanted:
        return assemble(labels, {})
    shared = spark.sparkContext.broadcast((X, labels))
    fitted = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(wanted)], "i int, a string, b string").repartitionById(len(wanted), F.col("i")).select("a", "b").mapInArrow(remote(__name__, "fit_rows", sample=shared), "a string, b string, w binary").collect()
    return assemble(labels, {(r[0], r[1]): np.frombuffer(bytes(r[2]), float) for r in fitted})


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, family, language, margin for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return slim(docs, "doc_id", "text").mapInArrow(remote(__name__, "label_rows", model=shared), SCHEMA)
