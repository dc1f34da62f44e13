"""The whole pass over documents: normalise, detect, cross-check by translation, merge, expand, collapse, choose, anonymize; switches leave parts of the plan out.

Votes are written once to the shared folder, as several later steps read them; texts are only scanned and joined, never checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, tables
from ..functions import text as tx
from ..operators import align, detect, models, prompts, replace, votes
from ..sources.shared import settled


@dataclass
class Options:
    """What a pass does. A detector that isn't given isn't run."""

    regex: bool = True
    rules: tuple = detect.RULES
    dictionary: DataFrame | None = None
    classifiers: list = field(default_factory=list)  # (function, weight)
    recognisers: list = field(default_factory=list)
    expand_public_figures: bool = True
    name_scores: DataFrame | None = None
    coreference: Callable | None = None  # (texts, lang) to lists of {start, end, cluster}
    question_models: tuple[Callable, Callable] | None = None  # prompts to answers, prompts to questions
    target: str | None = None  # language into which texts are translated
    translator: Callable | None = None  # (texts, source, target) to texts
    back_translator: Callable | None = None
    gate: bool = True  # translations that are not in the target language are given up
    back_weight: float = 0.9
    persons_only: bool = False
    anonymize: bool = True
    values: bool = False
    scope: tuple = replace.ANONYMIZE
    words_per_chunk: int = 70
    seed: int = 0
    compat: bool = False


def normalized(docs: DataFrame, lang: str = "en") -> DataFrame:
    """doc_id, lang, domain, text in the form that all offsets refer to."""
    rows = tx.with_defaults(docs, lang)
    return rows.select("doc_id", "lang", "domain", tx.normalize(F.col("text")).alias("text"))


def stopword_frame(docs: DataFrame) -> DataFrame:
    return tables.frame(docs.sparkSession, "stopwords").select("word").distinct()


def detected(docs: DataFrame, options: Options) -> DataFrame:
    """All votes of the detectors that are on."""
    found = []
    if options.regex:
        found.append(detect.with_patterns(docs, options.rules))
    if options.dictionary is not None:
        found.append(detect.public_figures(detect.with_dictionary(docs, options.dictionary, compat=options.compat)))
    if options.classifiers or options.recognisers:
        chunks = tx.chunks(docs, options.words_per_chunk)
        found += [models.with_model(chunks, f, models.assemble, w, f"classifier{k}") for k, (f, w) in enumerate(options.classifiers)]
        found += [models.with_model(chunks, f, models.recognised, w, f"recogniser{k}") for k, (f, w) in enumerate(options.recognisers)]
    if not found:
        raise ValueError("no detector is on")
    return votes.add_votes(*found)


def voted(docs: DataFrame, options: Options) -> DataFrame:
    """Votes of all detectors that are on, cleaned and expanded."""
    found = settled(votes.clean(detected(docs, options)))
    more = []
    if options.coreference is not None:
        more.append(models.with_coreference(docs, found, options.coreference))
    if options.question_models is not None:
        asked = settled(prompts.ask(docs, *options.question_models).select("doc_id", "question", "answer"))
        more.append(detect.from_questions(docs, found, asked))
    if more:
        found = settled(votes.add_votes(found, *more))
    if options.name_scores is not None:
        found = votes.add_votes(found, detect.common_names(found, options.name_scores))
    if options.expand_public_figures and (options.dictionary is not None or options.classifiers or options.recognisers):
        found = votes.add_votes(found, detect.expand_public_figures(found))
    return found


def labelled(docs: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """doc_id, ent, start, end, label, weight: spans that don't overlap, one label each."""
    labels = votes.collapse_labels(votes.roll_up(votes.merge(docs, found, options.compat)))
    rank = F.struct((-F.col("weight")).alias("w"), "label")
    pair = F.struct("label", "weight")
    best = F.max_by(pair, "label") if options.compat else F.min_by(pair, rank)
    return labels.groupBy(*votes.SPAN).agg(best.alias("b")).select(*votes.SPAN, "b.label", "b.weight")


def translated(docs: DataFrame, spans: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(texts: doc_id, lang, domain, text in the target language; links: doc_id, start, end, other_ent): mentions travel through the translator as numbered marks.

    Texts in the target language already, and such as the gate gives up, are left out.
    """
    rows = docs.where(F.col("lang") != options.target)
    marked = replace.mark_items(rows, spans).join(rows.select("doc_id", "lang", "domain"), "doc_id")
    made = None
    for lang in [r[0] for r in rows.select("lang").distinct().collect()]:  # a row for each language; a translator is for one pair
        one = align.translate(marked.where(F.col("lang") == lang), options.translator, lang, options.target, "marked")
        made = one if made is None else made.unionByName(one)
    if made is None:
        made = marked.withColumn("translated", F.lit(None).cast("string"))
    made = made.where(F.col("translated") != tx.MISSING).withColumn("b", align.bracket_links(align.repair_brackets(F.col("translated")), F.coalesce(F.size("items"), F.lit(0)), F.lit(options.target)))
    made = made.select("doc_id", "domain", F.col("b.text").alias("text"), F.col("b.links").alias("links"), "items")
    if options.gate:
        made = language.with_best_language(made.withColumn("shown", language.clipped(F.col("text"))), text_column="shown").drop("shown")
        made = made.where(F.col("best.best_lang").isNull() | (F.col("best.best_lang") == options.target)).drop("best")
    made = settled(made)
    links = made.select("doc_id", "items", F.inline("links")).withColumn("m", F.get("items", F.col("item")))
    return made.select("doc_id", F.lit(options.target).alias("lang"), "domain", "text"), links.where("m is not null").select("doc_id", "m.start", "m.end", F.col("ent").alias("other_ent"))


def back_projected(docs: DataFrame, texts: DataFrame, found: DataFrame, options: Options) -> DataFrame:
    """Votes in the source texts from those in the translations, by way of back translation and alignment."""
    spans = labelled(texts, found, options)
    marked = replace.mark_items(texts, spans).join(docs.select("doc_id", "lang", F.col("text").alias("chunk_text")), "doc_id")
    made = None
    for lang in [r[0] for r in docs.where(F.col("lang") != options.target).select("lang").distinct().collect()]:
        one = align.translate(marked.where(F.col("lang") == lang), options.back_translator, options.target, lang, "marked", "back_text")
        made = one if made is None else made.unionByName(one)
    if made is None:
        return found.where("false")
    made = settled(made.where(F.col("back_text") != tx.MISSING).select("doc_id", "lang", "chunk_text", align.repair_brackets(F.col("back_text")).alias("back_text"), F.lit(0).alias("char_offset"), "items"))
    numbered = made.select("doc_id", F.posexplode("items").alias("item", "m")).select("doc_id", "item", "m.start", "m.end")
    voted_items = numbered.join(spans.select("doc_id", "start", "end", "label", "weight"), ["doc_id", "start", "end"]).select("doc_id", "item", "label", F.lit("back").alias("signal"), "weight")
    return align.back_votes(made, voted_items, options.back_weight)


def cross_checked(docs: DataFrame, found: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(votes in the source texts, target texts, votes in these): labels that both languages agree on weigh more, mentions that became stopwords less."""
    found = settled(found)
    texts, links = translated(docs, labelled(docs, found, options), options)
    links, other = settled(links), settled(votes.clean(detected(texts, options)))
    stop = tables.frame(docs.sparkSession, "stopwords").where(F.col("lang") == options.target).select("word")
    both = votes.weaken_stopwords(votes.boost_matches(found, other, links), links, stop)
    other = votes.copy_labels(found, texts, other, links)
    if options.back_translator is not None:
        both = votes.add_votes(both, back_projected(docs, texts, settled(other), options))
    return both, texts, other


def entities(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """doc_id, ent, start, end, label, weight: spans that don't overlap, one label each."""
    options = options or Options()
    found = voted(docs, options)
    if options.translator is not None and options.target:
        found = cross_checked(docs, found, options)[0]
    return labelled(docs, found, options)


def augmented(docs: DataFrame, options: Options, lang: str = "en") -> DataFrame:
    """``process``'s rows for the source texts and for their translations, which have the target's language; mentions are replaced in both."""
    rows = normalized(docs, lang)
    both, texts, other = cross_checked(rows, voted(rows, options), options)
    how = (options.scope, options.values, options.seed, options.compat)
    own, away = (replace.anonymize(r, labelled(r, v, options), *how) for r, v in ((rows, both), (texts, other)))
    return own.unionByName(away)


def process(docs: DataFrame, options: Options | None = None, lang: str = "en") -> DataFrame:
    """doc_id, lang, text_anon, ner_anon, context of every document."""
    options = options or Options()
    rows = normalized(docs, lang)
    found = settled(entities(rows, options))
    if options.persons_only:
        rows = language.keep_persons(rows, found, seed=options.seed)
    if not options.anonymize:
        return rows
    return replace.anonymize(rows, found, options.scope, options.values, options.seed, options.compat)
