"""Translation round trips without a model of our own: routing, bracket repair and parsing, alignment of characters, similarity, projection of votes.

A translator is any function of (list of texts, source language, target language) that gives texts; it runs in Arrow batches, loaded once for each worker.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import arrow, tables
from ..functions import text as tx

MANY_TO_MANY = "m2m100_418M"
#: Pairs for which that model has been tuned.
TUNED = {("en", "yo"): "eng-yor", ("yo", "en"): "yor-eng", ("en", "zu"): "en-zu", ("zu", "en"): "zu-en"}
NO_SPACES = ("zh", "ja", "ki")


def translate(rows: DataFrame, translator: Callable[[list[str], str, str], list[str]], source: str, target: str, text: str = "text", out: str = "translated") -> DataFrame:
    """``rows`` with the translation of a column. Where a translator fails on a batch, its texts are tried one by one, and the ones it fails on give the sentinel of a missing text."""
    schema = StructType([*rows.schema.fields, StructField(out, StringType())])

    def attempt(texts: list[str]) -> list[str | None]:
        try:
            return list(translator(texts, source, target))
        except Exception:  # whatever a translator raises, the documents go on
            return [None] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = b[text].notna()
            made = pd.Series([None] * len(b), index=b.index, dtype=object)
            texts = b.loc[known, text].tolist()
            out_ = attempt(texts)
            if len(out_) != len(texts) or any(x is None for x in out_):
                out_ = [(attempt([t]) or [None])[0] for t in texts]
            made[known] = [tx.MISSING if x is None else x for x in out_]
            yield b.assign(**{out: made})

    return rows.mapInPandas(run, schema)


def models(spark: SparkSession) -> DataFrame:
    """(src, tgt, model): pairs of languages that have a translation model of their own."""
    return tables.frame(spark, "translation_models")


def route(pairs: DataFrame) -> DataFrame:
    """``pairs`` (src, tgt) with the model of the pair, or the model for many languages where there is none, tuned if it is for the pair."""
    table = models(pairs.sparkSession)
    tuned = reduce(lambda rest, x: F.when((F.col("src") == x[0][0]) & (F.col("tgt") == x[0][1]), f"{MANY_TO_MANY}-{x[1]}-mt").otherwise(rest), TUNED.items(), F.lit(MANY_TO_MANY))
    return pairs.join(F.broadcast(table), ["src", "tgt"], "left").withColumn("model", F.coalesce("model", tuned))  # 1,324 rows


def pivots(spark: SparkSession) -> DataFrame:
    """(src, mid, tgt): pairs without a model that two models connect; a self-join of the table of models."""
    t = models(spark)
    a, b = t.select("src", F.col("tgt").alias("mid")), t.select(F.col("src").alias("mid"), "tgt")
    return a.join(b, "mid").where("src <> tgt and src <> mid and mid <> tgt").join(t.select("src", "tgt"), ["src", "tgt"], "left_anti").select("src", "mid", "tgt").distinct()


_ROUNDS = (("[[", "["), ("]]", "]"), ("［", "["), ("］", "]"), ("【", "["), ("】", "]"), ("[", " [ "), ("]", " ] "), ("  ", " "))


def repair_brackets(c: Column) -> Column:
    """Brackets that a translation doubled, widened or glued to words, as single ones with spaces."""
    return F.trim(tx.replace_all(c, _ROUNDS))


def parse_brackets(text: str, items: int, cjk: bool = False, stopwords: frozenset = frozenset()) -> tuple[str, list[tuple[str, int]]]:
    """(text without marks, [(mention, number of its item)]) of a translated text with ``number [ mention ]`` marks."""
    found: dict[str, int] = {}
    while "[" in text:
        head, tail = (x.strip() for x in text.split("[", 1))
        words = head.split()
        if "]" not in tail or not words:
            text = f"{head} {tail}" if not cjk else head + tail
            continue
        ent, tail = tail.split("]", 1)
        ent = ent.strip()
        last = words[-1]
        digits = last[len(last.rstrip("0123456789")) :]
        if digits and int(digits) < items:
            head = " ".join(words[:-1])
            if ent.lower() not in stopwords and ent.strip(tx.STRIP):
                ent = ent.strip(tx.STRIP)
                found[ent] = int(digits)
        text = f"{head} {ent} {tail}"
    return text.replace("  ", " ").strip(), list(found.items())


def bracket_rows(text: pd.Series, items: pd.Series, lang: pd.Series) -> pd.DataFrame:
    """``parse_brackets`` of columns (text, number of items, target language)."""
    words = tables.stopwords()
    rows = [parse_brackets(t or "", 0 if pd.isna(n) else int(n), x in tx.CJK_TOKENS, words.get(x, frozenset())) for t, n, x in zip(text, items, lang)]
    return pd.DataFrame({"text": [r[0] for r in rows], "links": [[{"ent": e, "item": k} for e, k in r[1]] for r in rows]})


# ---- alignment -------------------------------------------------------------------------------------


def align(one: str, two: str, lang: str, mark: str = "]") -> tuple[list[tuple[str, str, int]], float]:
    """([(part of one, part of two, 1 if they are the same)], score) by matching blocks of characters.

    A differing part of the second text that holds ``]`` is cut there, and its counterpart into as many equal parts. The score is twice the ratio of matched
    characters to others, each plus one.
    """
    folds = str.maketrans(tx._FOLD_FROM, tx._FOLD_TO)
    one, two = one.translate(folds), two.translate(folds)
    parts: list[tuple[str, str, int]] = []
    a0 = b0 = same = other = 0
    for k, (a, b, n) in enumerate(difflib.SequenceMatcher(None, one, two).get_matching_blocks()):
        if k or a or b:
            gap_a, gap_b = one[a0:a], two[b0:b]
            parts += _cut(gap_a, gap_b, lang, mark) if "]" in gap_b else [(gap_a, gap_b, 0)]
            other += max(a - a0, b - b0)
        if n:
            parts.append((one[a : a + n], two[b : b + n], 1))
            a0, b0, same = a + n, b + n, same + n
    return parts, 2 * (same + 1) / (other + 1)


def _cut(gap_a: str, gap_b: str, lang: str, mark: str) -> list[tuple[str, str, int]]:
    spaced = lang not in NO_SPACES
    sep = " " if spaced else ""
    units = gap_a.split(" ") if spaced else list(gap_a)
    count = gap_b.count(mark) + gap_b.endswith((mark, f"{mark} "))
    step = len(gap_a) // count if count else 0
    pieces = [gap_a, *[""] * len(gap_a)] if step <= 0 else [sep.join(units[i : i + step]) for i in range(0, len(units), step)]
    return [(x + sep, y + mark, 0) for x, y in zip(pieces, gap_b.split("]"))]


def aligned_rows(one: pd.Series, two: pd.Series, lang: pd.Series) -> pd.DataFrame:
    rows = [align(a or "", b or "", x) for a, b, x in zip(one, two, lang)]
    return pd.DataFrame({"parts": [[{"a": a, "b": b, "same": s} for a, b, s in p] for p, _ in rows], "score": [round(s, 6) for _, s in rows]})


def project(source: str, back: str, lang: str, offset: int = 0) -> list[tuple[int, str, int, int]]:
    """(number of the item, mention, start, end) in ``source`` for the ``number [ mention ]`` marks of its back translation, by alignment."""
    folds = str.maketrans(tx._FOLD_FROM, tx._FOLD_TO)
    parts, a0, b0 = [], 0, 0
    for i, j, n in difflib.SequenceMatcher(None, source.translate(folds), back.translate(folds)).get_matching_blocks():
        parts += [(source[a0:i], back[b0:j]), (source[i : i + n], back[j : j + n])]
        a0, b0 = i + n, j + n
    out, at, open_at, number, tail = [], 0, None, None, ""
    for a, b in parts:
        for k, ch in enumerate(b):
            here = at + min(k, len(a))
            if ch == "[" and open_at is None:
                digits = tail.rstrip()[len(tail.rstrip().rstrip("0123456789")) :]
                number, open_at = (int(digits), here) if digits else (None, here)
            elif ch == "]" and open_at is not None:
                end = min(here if here > open_at else at + len(a), len(source))
                ent = source[open_at:end]
                lead = len(ent) - len(ent.lstrip(tx.STRIP))
                ent = ent.strip(tx.STRIP)
                if number is not None and ent:
                    out.append((number, ent, offset + open_at + lead, offset + open_at + lead + len(ent)))
                open_at = None
            tail = (tail + ch)[-12:]
        at += len(a)
    return [(n, e, s, z) for n, e, s, z in out if source[s - offset : z - offset] == e]


def projected_rows(source: pd.Series, back: pd.Series, lang: pd.Series, offset: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("item", "ent", "start", "end"), r)) for r in project(a or "", b or "", x, 0 if pd.isna(o) else int(o))] for a, b, x, o in zip(source, back, lang, offset)])


bracket_links = arrow.udf(__name__, "bracket_rows", "struct<text:string,links:array<struct<ent:string,item:int>>>")
aligned = arrow.udf(__name__, "aligned_rows", "struct<parts:array<struct<a:string,b:string,same:int>>,score:double>")
projected = arrow.udf(__name__, "projected_rows", "array<struct<item:int,ent:string,start:int,end:int>>")


def back_votes(chunks: DataFrame, target_votes: DataFrame, back_weight: float = 0.9) -> DataFrame:
    """Votes in the source text from a back translation: ``chunks`` (doc_id, lang, chunk_text, back_text, char_offset), ``target_votes`` (doc_id, item, label, signal, weight).

    Each projected label weighs ``back_weight`` plus the weight it had in the target text.
    """
    rows = chunks.select("doc_id", F.explode(projected("chunk_text", "back_text", "lang", "char_offset")).alias("p")).select("doc_id", "p.*")
    got = rows.join(target_votes, ["doc_id", "item"])
    return got.groupBy("doc_id", "ent", "start", "end", "label", "signal").agg(F.round(F.lit(back_weight) + F.sum("weight"), 6).alias("weight"))


# ---- similarity ------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if they differ in length or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.when(norm > 0, norm))
