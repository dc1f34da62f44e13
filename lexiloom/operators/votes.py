"""From votes to one set of labelled spans: cleaning, overlap merge, roll-up of signals, label rules, choice, ontology, votes across languages.

Two modes: ``fixed`` (the default) keeps spans whole, touching and moved with what is stripped; ``compat`` has the quirks of the rule as published:
a mention inside another one shrinks it, trimmed neighbours leave a gap of one character, starts stay where they were when characters are stripped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as tx

SPAN = ["doc_id", "ent", "start", "end"]
#: (label that goes, label that gets its weight or None, label that must be there), in this order.
RULES = (("PERSON", "PUBLIC_FIGURE"), ("LOC", "ADDRESS"), ("DATE", "AGE"), ("ID", None), ("CARDINAL", "ID"))
BOOST, OVERLAP = 1.1, 3


def is_number(c: Column) -> Column:
    """Reads as a number other than zero; nan and inf are numbers."""
    plain = F.trim(c)
    return F.lower(plain).rlike("^[+-]?(nan|inf|infinity)$") | (plain.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$") & (F.coalesce(plain.try_cast("double"), F.lit(0.0)) != 0))


def clean(votes: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """Votes without those for short numbers, stopwords (word) and single characters (outside Chinese, Japanese, Korean and Thai)."""
    ent = F.col("ent")
    kept = votes.where(~((F.length(ent) < 4) & is_number(ent)) & ~((F.length(ent) <= 1) & tx.script(ent).isNull()))
    if stopwords is None:
        return kept
    stop = stopwords.select(F.col("word").alias("__w")).distinct()
    return kept.join(stop, F.lower(ent) == F.col("__w"), "left_anti")


def span_order(start: Column, end: Column) -> list[Column]:
    """Ascending start, the longer one first."""
    return [start.asc(), (end - start).desc()]


def merged_spans(spans: Column, compat: bool = False) -> Column:
    """array<struct<start, end, votes>> without overlaps, from the same in any order; votes are array<struct<label, signal, weight>>.

    One fold over the sorted spans, within the row. A span that lies within the last kept one, or shares more than OVERLAP characters with it, gives
    it its votes; one that begins after it is kept; of two that share less, the shorter is trimmed.
    """
    kind = "array<struct<start:int,end:int,votes:array<struct<label:string,signal:string,weight:double>>>>"
    span = lambda a, z, v: F.struct(a.alias("start"), z.alias("end"), v.alias("votes"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["votes"].alias("votes"))))
    gap = 1 if compat else 0

    def step(acc: Column, m: Column) -> Column:
        start, end = m["start"], -m["back"]
        prev = F.try_element_at(acc, F.lit(-1))
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        within = (prev["end"] >= end) | (prev["end"] - start > OVERLAP)
        whole = F.array_append(before, span(prev["start"], end if compat else F.greatest(prev["end"], end), F.concat(prev["votes"], m["votes"])))
        apart = prev["end"] < start if compat else prev["end"] <= start
        longer = end - start > prev["end"] - prev["start"]
        cut_prev = F.array_append(F.array_append(before, span(prev["start"], start - gap, prev["votes"])), span(start, end, m["votes"]))
        cut_this = F.array_append(acc, span(prev["end"] + gap, end, m["votes"]))
        return F.when((F.size(acc) == 0) | apart, F.array_append(acc, span(start, end, m["votes"]))).when(within, whole).when(longer, cut_prev).otherwise(cut_this).cast(kind)

    # in the published rule, containment is asked first; spans that lie apart can't be contained unless they are empty
    folded = F.aggregate(ordered, F.array().cast(kind), step)
    if compat:
        return folded

    def settle(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        given = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), span(last["start"], last["end"], F.concat(last["votes"], s["votes"])))
        return F.when(s["end"] > s["start"], F.array_append(acc, s)).when(F.size(acc) > 0, given).otherwise(acc).cast(kind)

    return F.aggregate(folded, F.array().cast(kind), settle)


def strip_span(ent: Column, start: Column, compat: bool = False) -> tuple[Column, Column]:
    """(stripped mention, its start)."""
    chars = F.lit(tx.STRIP)
    return F.btrim(ent, chars), start if compat else start + F.length(ent) - F.length(F.ltrim(ent, chars))


def span_groups(votes: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, spans): ``merged_spans`` of each run of votes that overlap one after the other.

    What begins where all spans before it have ended is always kept apart, so the fold goes over a run, never over all spans of a document. A run that lies within
    its first span is that span with all votes, without a fold. Empty spans begin no run: their votes go to the span before.
    """
    order = Window.partitionBy("doc_id").orderBy("start", F.col("end").desc())
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = votes.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.struct("label", "signal", "weight").alias("v")).withColumn("__upto", upto)
    apart = (F.col("start") > F.col("__upto") if compat else F.col("start") >= F.col("__upto")) & (F.col("end") > F.col("start"))
    rows = rows.withColumn("__run", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.max(F.struct((-F.col("start")).alias("s"), F.col("end").alias("z")))
    runs = rows.groupBy("doc_id", "__run").agg(first.alias("first"), F.max("end").alias("z"), F.array_sort(F.collect_list(F.struct("start", "end", "v"))).alias("m"))
    whole = F.array(F.struct((-F.col("first.s")).alias("start"), F.col("z").alias("end"), F.transform("m", lambda x: x["v"]).alias("votes")))
    folded = merged_spans(F.transform("m", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array(x["v"]).alias("votes"))), compat)
    single = F.size("m") == 1 if compat else (F.col("first.z") == F.col("z")) & (F.col("z") > -F.col("first.s"))
    return runs.select("doc_id", F.when(single, whole).otherwise(folded).alias("spans"))


def merge(docs: DataFrame, votes: DataFrame, compat: bool = False) -> DataFrame:
    """Votes on spans that don't overlap: (doc_id, ent, start, end, label, signal, weight). Only votes are shuffled; texts are met in the join by doc_id, once for each document."""
    lists = span_groups(votes, compat).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = lists.join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", F.explode_outer(tx.with_pieces(F.col("text"), F.col("spans"))).alias("s")).where("s is not null").select("doc_id", "s.*")
    ent, start = strip_span(F.col("piece"), F.col("start"), compat)
    rows = rows.select("doc_id", ent.alias("ent"), start.alias("start"), "votes").where("ent <> ''")
    rows = rows.select("doc_id", "ent", "start", (F.col("start") + F.length("ent")).alias("end"), F.inline("votes"))
    return rows.groupBy(*SPAN, "label", "signal").agg(F.round(F.sum("weight"), 6).alias("weight"))


def roll_up(votes: DataFrame) -> DataFrame:
    """Weights by label, whatever the signal."""
    return votes.groupBy(*SPAN, "label").agg(F.round(F.sum("weight"), 6).alias("weight"))


def collapse_labels(rolled: DataFrame) -> DataFrame:
    """``roll_up``'s rows after the label rules: a general label gives its weight to the special one that is there too; DATE drives out ID.

    One aggregate by span, with a sum for each label that a rule names.
    """
    named = sorted({x for goes, gets in RULES for x in (goes, gets or "DATE")})
    pair = "array<struct<label:string,weight:double>>"
    other = F.collect_list(F.when(~F.col("label").isin(*named), F.struct("label", "weight"))).cast(pair)
    rows = rolled.groupBy(*SPAN).agg(*[F.sum(F.when(F.col("label") == x, F.col("weight"))).alias(f"__{x}") for x in named], other.alias("__other"))
    for goes, gets in RULES:
        both = F.col(f"__{goes}").isNotNull() & F.col(f"__{gets or 'DATE'}").isNotNull()
        given = {f"__{gets}": F.when(both, F.round(F.col(f"__{gets}") + F.col(f"__{goes}"), 6)).otherwise(F.col(f"__{gets}"))} if gets else {}
        rows = rows.withColumns({f"__{goes}": F.when(~both, F.col(f"__{goes}"))} | given)
    kept = F.filter(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"__{x}").alias("weight")) for x in named]).cast(pair), lambda m: m["weight"].isNotNull())
    return rows.select(*SPAN, F.inline(F.concat(kept, "__other")))


def collapse(docs: DataFrame, votes: DataFrame, stopwords: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Cleaning, overlap merge, roll-up and label rules."""
    return collapse_labels(roll_up(merge(docs, clean(votes, stopwords), compat)))


def choose_label(labels: DataFrame, compat: bool = False) -> DataFrame:
    """One label for each span: that of the greatest weight, ties to the alphabetically first; ``compat``: the alphabetically last label."""
    heaviest = F.min_by("label", F.struct((-F.col("weight")).alias("w"), "label"))
    pick = F.max("label") if compat else heaviest
    return labels.groupBy(*SPAN).agg(pick.alias("label"))


def expand_labels(labels: DataFrame) -> DataFrame:
    """A row for each label above a span's label, itself included; fine labels are made coarse first."""
    spark = labels.sparkSession
    coarse = reduce(lambda rest, x: F.when(F.col("label") == x[0], x[1]).otherwise(rest), tables.COARSE.items(), F.col("label"))
    above = spark.createDataFrame(tables.ontology(), "label string, ancestor string")
    return labels.withColumn("label", coarse).join(F.broadcast(above), "label")  # 37 rows


# ---- across languages ------------------------------------------------------------------------------


def boost_matches(votes: DataFrame, other: DataFrame, links: DataFrame, factor: float = BOOST) -> DataFrame:
    """``votes`` of the source language, times ``factor`` where the translation found the same label (or MISC) for the linked mention.

    ``links`` (doc_id, start, end, other_ent) say as what a mention was translated. Mentions of ``other`` with that text count; if there is none and it has more than three
    characters, those that contain it or (of more than three) are contained in it.
    """
    pool = other.select("doc_id", F.col("ent").alias("oe"), F.col("label").alias("ol"), F.col("signal").alias("os")).distinct()
    met = links.join(pool, "doc_id").withColumn("same", F.col("oe") == F.col("other_ent"))
    part = (F.length("other_ent") > 3) & (F.contains("oe", F.col("other_ent")) | ((F.length("oe") > 3) & F.contains("other_ent", F.col("oe"))))
    met = met.where(F.col("same") | part)
    key = ["doc_id", "start", "end"]
    full = met.groupBy(*key, "other_ent").agg(F.max("same").alias("any_same"))
    met = met.join(full, [*key, "other_ent"]).where(F.col("same") | ~F.col("any_same"))
    labels = met.groupBy(*key).agg(F.collect_set(F.struct("ol", "os")).alias("labels"))
    rows = votes.join(labels, key, "left")
    agrees = F.exists("labels", lambda x: ((x["ol"] == F.col("label")) & (x["os"] == F.col("signal"))) | (x["ol"] == "MISC"))
    return rows.withColumn("weight", F.round(F.when(F.coalesce(agrees, F.lit(False)), F.col("weight") * factor).otherwise(F.col("weight")), 6)).drop("labels")


def weaken_stopwords(votes: DataFrame, links: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Votes halved where the mention was translated as a stopword of the target language."""
    stop = stopwords.select(F.col("word").alias("__w")).distinct()
    hit = links.join(stop, F.lower("other_ent") == F.col("__w"), "left_semi").select("doc_id", "start", "end").distinct().withColumn("__half", F.lit(0.5))
    return votes.join(hit, ["doc_id", "start", "end"], "left").withColumn("weight", F.round(F.col("weight") * F.coalesce("__half", F.lit(1.0)), 6)).drop("__half")


def add_votes(*votes: DataFrame) -> DataFrame:
    """Votes of several frames, summed where mention, label and signal are the same."""
    every = reduce(DataFrame.unionByName, [v.select(*SPAN, "label", "signal", "weight") for v in votes])
    return every.groupBy(*SPAN, "label", "signal").agg(F.round(F.sum("weight"), 6).alias("weight"))


def copy_labels(source: DataFrame, target_docs: DataFrame, target: DataFrame, links: DataFrame) -> DataFrame:
    """``target`` votes and those of linked source mentions for every place of the translated mention in the target text."""
    from .detect import occurrences

    at = links.join(target_docs.select("doc_id", "text"), "doc_id").where("other_ent <> ''").select("doc_id", "start", "end", "other_ent", F.explode(occurrences(F.col("text"), F.col("other_ent"))).alias("at"))
    copied = at.join(source.select("doc_id", "start", "end", "label", "signal", "weight"), ["doc_id", "start", "end"])
    copied = copied.select("doc_id", F.col("other_ent").alias("ent"), F.col("at").alias("start"), (F.col("at") + F.length("other_ent")).alias("end"), "label", "signal", "weight")
    return add_votes(target, copied)
