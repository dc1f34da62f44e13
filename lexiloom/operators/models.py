"""What models return made into votes: token classifiers, entity recognisers, coreference. Models are given as functions; none is shipped.

Each rule is a fold over a chunk's predictions in order, so it runs in Arrow batches next to the model: texts don't move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import arrow, tables
from ..functions import text as tx
from .detect import MENTION

CLASSIFIER_WEIGHT, RECOGNISER_WEIGHT = 1.25, 1.0
_SAME = {
    "ADDRESS": "ADDRESS", "STREET_ADDRESS": "ADDRESS", "PUBLIC_FIGURE": "PUBLIC_FIGURE", "NAME": "PERSON", "PER": "PERSON", "PERSON": "PERSON", "LOCATION": "LOC", "LOC": "LOC", "GPE": "LOC",
    "ORGANIZATION": "ORG", "ORG": "ORG", "AGE": "AGE", "NORP": "NORP", "BIO": "DISEASE", "SYMPTOM_AND_DISEASE": "DISEASE", "DISEASE": "DISEASE", "PATIENT_ID": "ID", "GOVT_ID": "ID", "USER_ID": "ID", "ID": "ID",
}
_KEPT = ("PERSON", "LOC", "ORG", "NORP", "DATE", "AGE")
PRONOUNS = {"he": "he", "him": "he", "his": "he", "himself": "he", "she": "she", "her": "she", "hers": "she", "herself": "she", "they": "they", "them": "they", "their": "they", "theirs": "they"}


class Detector(Protocol):
    """Predictions for texts: for each a list of {word, entity, start, end} (start and end may be None: the word is then looked for)."""

    def __call__(self, texts: list[str], lang: str) -> list[list[dict]]: ...


def label_of(entity: str, word: str) -> str:
    label = entity.split("-", 1)[-1].upper()
    return "ID" if label == "MISC" and "@" in word else _SAME.get(label, "MISC")


def word_spans(text: str, predictions: list[dict], strip: str = tx.STRIP) -> list[dict]:
    """Predictions with places in the text: unknown words out, in order, widened to whole words, stripped, none within the one before."""
    rows = [dict(p) for p in predictions if p["word"] not in ("[UNK]", "<unk>")]
    if rows and rows[0].get("start") is None:
        at, placed = 0, []
        for p in sorted(rows, key=lambda p: p.get("index", 0)):
            word = p["word"].rstrip("@")
            k = text.find(word, at)
            if k >= 0:
                placed.append(p | {"word": word, "start": k, "end": k + len(word)})
                at = k + 1
        rows = placed
    out: list[dict] = []
    for p in sorted(rows, key=lambda p: p["start"]):
        start, end = p["start"], min(p["end"], len(text))
        if start >= len(text):
            continue
        if not any(_wide(ch) for ch in text[start:end]):
            while start > 0 and text[start] not in strip and text[start - 1] not in strip:
                start -= 1
            while end < len(text) and text[end] != " ":
                end += 1
        while start < end and text[start] in strip:
            start += 1
        end = start + len(text[start:end].rstrip(strip))
        if start < end and not (out and out[-1]["end"] > start):
            out.append(p | {"word": text[start:end], "start": start, "end": end})
    return out


def _wide(ch: str) -> bool:
    c = ord(ch)
    return 0x4E00 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0x3040 <= c <= 0x30FF or 0x0E01 <= c <= 0x0E5B


def assemble(text: str, predictions: list[dict], stopwords: frozenset = frozenset(), gap: int = 5) -> list[tuple[str, int, int, str]]:
    """(mention, start, end, label): neighbours of one label, at most ``gap`` characters apart, are one mention unless the second begins anew (B-)."""
    spans: list[list] = []
    for p in word_spans(text, predictions):
        label, begins = label_of(p["entity"], p["word"]), p["entity"].startswith("B-")
        if spans and not begins and spans[-1][2] == label and spans[-1][1] >= p["start"] - gap:
            spans[-1][1] = max(spans[-1][1], p["end"])
        else:
            spans.append([p["start"], p["end"], label])
    return [(text[a:z], a, z, label) for a, z, label in spans if z > a and text[a:z].lower() not in stopwords]


def recognised(text: str, entities: list[dict], stopwords: frozenset = frozenset(), strip: str = tx.STRIP) -> list[tuple[str, int, int, str]]:
    """An entity recogniser's results: labels made coarse, mentions stretched to the next space, stripped, looked for from left to right."""
    out, at = [], 0
    for e in entities:
        label = {"GPE": "LOC", "FAC": "LOC"}.get(e["entity"], e["entity"])
        label = label if label in _KEPT else "MISC"
        start = text.find(e["word"], at)
        if start < 0:
            continue
        end = start + len(e["word"])
        if not any(map(_wide, e["word"])):
            end += len(text[end:].split(" ", 1)[0])
        at = start + 1
        lead = len(text[start:end]) - len(text[start:end].lstrip(strip))
        ent = text[start:end].strip(strip)
        if ent and ent.lower() not in stopwords:
            out.append((ent, start + lead, start + lead + len(ent), label))
    return out


def with_model(chunks: DataFrame, detector: Callable[[list[str], str], list[list[dict]]], rule=assemble, weight: float = CLASSIFIER_WEIGHT, signal: str = "model") -> DataFrame:
    """Votes of a detector on ``chunks`` (doc_id, lang, chunk_text, char_offset), in Arrow batches; one call for each language of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: dict[tuple, float] = {}
            for lang, part in b.groupby("lang", dropna=False):
                stop = tables.stopwords().get(lang, frozenset())
                texts = part["chunk_text"].fillna("").tolist()
                for doc, offset, text, found in zip(part["doc_id"], part["char_offset"], texts, detector(texts, lang)):
                    for ent, start, end, label in rule(text, found, stop):
                        key = (doc, ent, int(start + offset), int(end + offset), label, signal)
                        rows[key] = rows.get(key, 0.0) + weight * (1 + len(ent) / 100)
            yield pd.DataFrame([(*k, round(v, 6)) for k, v in rows.items()], columns=["doc_id", "ent", "start", "end", "label", "signal", "weight"])

    return chunks.select("doc_id", "lang", "chunk_text", "char_offset").mapInPandas(run, MENTION)


# ---- coreference -----------------------------------------------------------------------------------


def cluster_key(ent: str, stopwords: frozenset = frozenset()) -> str:
    """Mentions of over two words are known by their last two, capital abbreviations and their full forms by initials, others by themselves."""
    words = ent.lower().split()
    content = [w for w in words if w not in stopwords]
    if len(words) > 2:
        return " ".join(words[-2:])
    return ent.lower() if not (ent.isupper() and len(ent) >= 2) else "".join(w[0] for w in content) if len(content) > 1 else ent.lower()


def coreference(mentions: list[dict], stopwords: frozenset = frozenset()) -> list[dict]:
    """Mentions ({start, end, ent, label or None, cluster}) with labels spread over clusters, and pronouns for persons.

    A personal pronoun makes a cluster's mentions persons; else the commonest label (ties to the first in the alphabet) goes to mentions without one.
    A public figure stays one. Overlapping mentions: those with labels first, then the longer; the rest give way.
    """
    groups: dict[object, list[dict]] = {}
    for m in mentions:
        groups.setdefault(m["cluster"] if m.get("cluster") is not None else cluster_key(m["ent"], stopwords), []).append(m)
    labelled: list[dict] = []
    for key, members in groups.items():
        said = Counter(PRONOUNS[w] for m in members for w in m["ent"].lower().split() if w in PRONOUNS)
        votes = Counter(m["label"] for m in members if m.get("label"))
        label = "PERSON" if said else min(votes, key=lambda x: (-votes[x], x)) if votes else None
        # without any pronoun the choice is by hash of the key, so it is the same in every run
        pronoun = min(said, key=lambda x: (-said[x], x)) if said else ("he", "she", "they")[sum(map(ord, str(key))) % 3]
        for m in members:
            own = m.get("label")
            new = own if own and (own == "PUBLIC_FIGURE" or not said) else label
            if new:
                labelled.append(m | {"label": new, "pronoun": pronoun if new in ("PERSON", "PUBLIC_FIGURE") else None, "had": own is not None})
    kept: list[dict] = []
    for m in sorted(labelled, key=lambda m: (not m["had"], -(m["end"] - m["start"]), m["start"])):
        if all(m["end"] <= k["start"] or m["start"] >= k["end"] for k in kept):
            kept.append(m)
    out = [{k: v for k, v in m.items() if k != "had"} for m in kept if m["label"] not in ("CARDINAL", "WORK_OF_ART") and m["ent"].lower() not in stopwords]
    return sorted(out, key=lambda m: m["start"])


def spread_labels(mentions: DataFrame) -> DataFrame:
    """``mentions`` (doc_id, ent, start, end, label, cluster) with each cluster's commonest label for those without one: a grouping by (doc_id, cluster)."""
    counts = mentions.where("label is not null and cluster is not null").groupBy("doc_id", "cluster", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id", "cluster").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("best"))
    return mentions.join(best, ["doc_id", "cluster"], "left").withColumn("label", F.coalesce("label", "best")).select(*mentions.columns)


def coreference_rows(mentions: pd.Series, lang: pd.Series) -> pd.Series:
    words = tables.stopwords()
    return pd.Series([[{k: m.get(k) for k in ("ent", "start", "end", "label", "pronoun")} for m in coreference([dict(m) for m in ms], words.get(x, frozenset()))] for ms, x in zip(mentions, lang)])


_coreference = arrow.udf(__name__, "coreference_rows", "array<struct<ent:string,start:int,end:int,label:string,pronoun:string>>")


def with_coreference(docs: DataFrame, votes: DataFrame, resolver: Callable[[list[str], str], list[list[dict]]], weight: float = 1.0, signal: str = "coref") -> DataFrame:
    """Votes from a coreference model: ``resolver`` gives for each text mentions {start, end, cluster} (cluster may be None).

    A mention has the heaviest label that ``votes`` give its span, or none; labels spread over clusters within the document. The model runs in Arrow
    batches on whole texts; only mentions are shuffled, and one document's are together.
    """
    schema = StructType([docs.schema["doc_id"], docs.schema["lang"], *StructType.fromDDL("ent string, start int, end int, cluster string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, part in b.groupby("lang", dropna=False):
                texts = part["text"].fillna("").tolist()
                for doc, text, found in zip(part["doc_id"], texts, resolver(texts, lang)):
                    rows += [(doc, lang, text[m["start"] : m["end"]], m["start"], m["end"], None if m.get("cluster") is None else str(m["cluster"])) for m in found]
            yield pd.DataFrame(rows, columns=schema.names)

    named = docs.select("doc_id", "lang", "text").mapInPandas(run, schema)
    label = votes.groupBy("doc_id", "start", "end", "label").agg(F.sum("weight").alias("w")).groupBy("doc_id", "start", "end").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("label"))
    lists = named.join(label, ["doc_id", "start", "end"], "left").groupBy("doc_id", "lang").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ent", "label", "cluster"))).alias("m"))
    rows = lists.select("doc_id", F.inline(_coreference("m", "lang")))
    return rows.select("doc_id", "ent", "start", "end", "label", F.lit(signal).alias("signal"), F.round(F.lit(weight) * (1 + F.length("ent") / 100), 6).alias("weight"))
