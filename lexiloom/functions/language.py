"""Language identification and quality scoring: stopword shares, groups of languages that are easily confused, the agreement rule, gates.

The stopword table has fixed size (22,614 words) and is loaded once by each worker. Scores are worked out within the row, in one Arrow pass that
holds one text at a time besides its batch: no word leaves its text, nothing is shuffled, and repeated rows of a doc_id don't add up.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrow, tables, text

#: Languages that are scored by characters.
CHARACTER_LANGS = ("zh", "zh-classical", "zh-min-nan", "zh-yue", "ko", "ja", "th", "jv")
CJK_SCALE, WINDOW = 1.5, 3
BOOST, UNSURE = 1.5, (0.4, 0.7)
SIMILAR, SIMILAR_AUGMENT, SIMILAR_BACK = 0.75, 0.5, 0.70


def longest_stopword(spark) -> DataFrame:
    """(lang, max_len): code points of the longest stopword of each language."""
    return tables.frame(spark, "stopwords").groupBy("lang").agg(F.max(F.length("word")).alias("max_len"))


_longest: dict[str, int] = {}


def _character_score(lang: str, doc: str) -> float | None:
    words = tables.stopwords()[lang]
    if lang not in _longest:
        _longest[lang] = max(map(len, words))
    chars = "".join(doc.lower().split())
    i = hits = units = 0
    while i < len(chars):
        take = next((k for k in range(min(_longest[lang], len(chars) - i), 0, -1) if chars[i : i + k] in words), 0)
        hits += take > 0
        units += 1
        i += take or 1
    return CJK_SCALE * hits / units if units else None


def own_scores(lang: pa.Array, doc: pa.Array) -> pa.Array:
    table = tables.stopwords()

    def one(lang, doc):
        if lang not in table:
            return None if doc is None and lang not in CHARACTER_LANGS else 1.0
        if doc is None:
            return None
        if lang in CHARACTER_LANGS:
            return _character_score(lang, doc)
        words, known = doc.lower().split(), table[lang]
        return sum(w in known for w in words) / len(words) if words else None

    return pa.array([one(x.as_py(), d.as_py()) for x, d in zip(lang, doc)], pa.float64())


_by_word: dict[str, dict[str, tuple[str, ...]]] = {}


def best_scores(languages: pa.Array, doc: pa.Array) -> pa.Array:
    """``languages``: the same on all rows, names apart by spaces; none for all that have a list."""
    key = languages[0].as_py() if len(languages) else ""
    if key not in _by_word:
        of: dict[str, list[str]] = {}
        for lang in key.split() or sorted(tables.stopwords()):
            for w in tables.stopwords().get(lang, ()):
                of.setdefault(w, []).append(lang)
        _by_word[key] = {w: tuple(x) for w, x in of.items()}
    of = _by_word[key]

    def one(text):
        words = text.lower().split() if text else ()
        hits = Counter(lang for w in words for lang in of.get(w, ()))
        if not hits:
            return None, 0.0
        lang = min(hits, key=lambda x: (-hits[x], x))
        return lang, hits[lang] / len(words)

    found = [one(t.as_py()) for t in doc]
    return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["best_lang", "score"])


_own_score = arrow.udf(__name__, "own_scores", "double", arrays=True)
_best_score = arrow.udf(__name__, "best_scores", "struct<best_lang:string,score:double>", arrays=True)


def stopword_score(docs: DataFrame, text_column: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, score) of every row: share of stopwords among words; 1.5 times their share among the units in languages written without spaces.

    1 for languages without a list; null for a text without words.
    """
    return docs.select("doc_id", F.col(lang).alias("lang"), _own_score(F.col(lang), F.col(text_column)).alias("score"))


def with_best_language(docs: DataFrame, languages: tuple[str, ...] | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with ``best`` (struct<best_lang, score>): the language most of whose stopwords a text has, and their share; ties go to the alphabetically first.

    A text without any stopword, an empty one or none: null, and 0.
    """
    return docs.withColumn("best", _best_score(F.lit(" ".join(languages or ())), F.col(text_column)))


def best_language(docs: DataFrame, languages: tuple[str, ...] | None = None, text_column: str = "text") -> DataFrame:
    """(doc_id, best_lang, score) of every row."""
    return with_best_language(docs, languages, text_column).select("doc_id", "best.best_lang", "best.score")


def group_table(spark) -> DataFrame:
    """(lang, member) of the groups of languages that are easily confused."""
    return spark.createDataFrame(tables.grouped_languages(), "lang string, member string")


def in_group(lang: Column, of: Column) -> Column:
    """Is ``lang`` in the group of ``of``? A language without a group is alone in its own."""
    groups: dict[tuple, list] = {}
    for x, y in tables.grouped_languages():
        groups.setdefault(x, []).append(y)
    by: dict[tuple, list] = {}
    for x, members in groups.items():
        by.setdefault(tuple(members), []).append(x)
    alone = lang == of
    return reduce(lambda rest, g: F.when(of.isin(*g[1]), lang.isin(*g[0])).otherwise(rest), by.items(), alone)


def agreed_score(first: Column, score: Column, second: Column) -> Column:
    """The first identifier's score, half as much again where the second one names a related language or the first is unsure."""
    unsure = (score > UNSURE[0]) & (score < UNSURE[1])
    return F.when(((first != second) | unsure) & in_group(first, second), score * BOOST).otherwise(score)


def clipped(c: Column) -> Column:
    """What an identifier is shown: lower case, in one line, 1,000 characters, no emoji."""
    return text.strip_emoji(F.left(F.replace(F.lower(c), F.lit("\n"), F.lit(" ")), F.lit(1000)))


def gate(translated: Column, found_lang: Column, target: Column) -> Column:
    """A translation whose language isn't the target's is given up; if its language isn't known it is kept."""
    return F.when(found_lang.isNull() | (found_lang == target), translated).otherwise(F.lit(text.MISSING))


def similar_enough(score: Column, use: str = "translate") -> Column:
    return score >= {"translate": SIMILAR, "augment": SIMILAR_AUGMENT, "back": SIMILAR_BACK}[use]


def countries(docs: DataFrame, column: str = "country") -> DataFrame:
    """``docs`` with a row for each language of the country (two-letter code), the first one having rank 0."""
    return docs.join(F.broadcast(tables.frame(docs.sparkSession, "country_languages")), column)  # 345 rows


def keep_persons(docs: DataFrame, mentions: DataFrame, probability: int = 100, labels: tuple[str, ...] = ("PERSON", "PUBLIC_FIGURE", "ID"), seed: int = 7) -> DataFrame:
    """Documents without mentions, or with one of ``labels``, and one in ``probability + 1`` of the others by a hash of doc_id.

    If no document or every document would go, all stay. The decision travels with the documents: one aggregate by doc_id.
    """
    has = mentions.groupBy("doc_id").agg(F.max(F.col("label").isin(*labels).cast("int")).alias("__person"))
    lot = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(probability + 1))
    marked = docs.join(has, "doc_id", "left").withColumn("__keep", F.coalesce(F.col("__person") == 1, F.lit(True)) | (lot == 0))
    any_kept = marked.agg(F.coalesce(F.max(F.col("__keep").cast("int")), F.lit(0)).alias("__any"))
    return marked.crossJoin(F.broadcast(any_kept)).where((F.col("__any") == 0) | F.col("__keep")).select(*[F.col(f"`{c}`") for c in docs.columns])  # one row
