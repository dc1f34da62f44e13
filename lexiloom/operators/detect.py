"""Detectors: from texts to weighted votes (doc_id, ent, start, end, label, signal, weight), offsets in code points, end exclusive.

A vote weighs ``weight * (1 + length / 100)``. Pattern and dictionary detectors are Catalyst expressions within the row, so texts are
never shuffled; the dictionary is joined by its own size (Catalyst broadcasts it only below its threshold).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as tx

MENTION = "doc_id long, ent string, start int, end int, label string, signal string, weight double"
REGEX_WEIGHT, DICTIONARY_WEIGHT, NEAR = 1.5, 0.85, 20
CAPITALISED = ("PERSON", "PUBLIC_FIGURE", "ORG", "LOC")
NGRAM, OPEN_LENGTH, BROADCAST_KEYS, HITS = 5, 20, 200_000, 1_000


@dataclass(frozen=True)
class Rule:
    """A pattern without capturing groups that never matches an empty string, in the syntax that RE2 and Java share.

    With ``context`` (a pattern), a match counts only where that is found within NEAR characters on either side. ``must``: a string that every
    match has; a text without it isn't searched.
    """

    label: str
    pattern: str
    context: str | None = None
    must: str | None = None


RULES = (
    Rule("EMAIL", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", must="@"),
    Rule("IP_ADDRESS", "(?:[0-9]{1,3}[.]){3}[0-9]{1,3}"),
    Rule("PHONE", "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}", must="("),
    Rule("KEY", "[0-9a-f]{40}", "(?i)token|key|secret|password"),
    Rule("ID", "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
)


#: Rules for user names and number plates, which need their context to be told.
CONTEXT_RULES = (
    Rule("USER", "@[A-Za-z][A-Za-z0-9_]{2,}", "(?i)user|account|handle|follow|profile", "@"),
    Rule("LICENSE_PLATE", "[A-Z]{1,3}[ -][0-9]{3,4}[A-Z]{0,2}", "(?i)plate|licen[cs]e|registration|vehicle"),
)


def vote(ent: Column, weight: float) -> Column:
    return F.round(F.lit(weight) * (1.0 + F.length(ent) / 100), 6)


def found(c: Column, pattern: str) -> Column:
    """array<struct<ent, start>> of all matches: pieces between the matches give their offsets."""

    def places(x: Column) -> Column:
        pieces, hits = x["pieces"], x["hits"]
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        ends = tx.running_sums(sizes)
        return F.zip_with(hits, ends, lambda h, e: F.struct(h.alias("ent"), (e - F.length(h)).alias("start")))

    return tx.let(F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("hits"), F.split(c, pattern).alias("pieces")), places)


def matches(c: Column, rules: tuple[Rule, ...] = RULES, near: int = NEAR) -> Column:
    """array<struct<ent, start, label>> of the matches of every rule. Where a rule doesn't occur in a text, one pass finds that out, and nothing is built."""

    def one(rule: Rule) -> Column:
        hits = found(c, rule.pattern)
        if rule.context:
            about = lambda m: F.substring(c, F.greatest(m["start"] - near, F.lit(0)) + 1, F.length(m["ent"]) + near + F.least(m["start"], F.lit(near)))
            hits = F.filter(hits, lambda m: about(m).rlike(rule.context))
        rows = F.transform(hits, lambda m: F.struct(m["ent"].alias("ent"), m["start"].alias("start"), F.lit(rule.label).alias("label")))
        there = F.contains(c, F.lit(rule.must)) if rule.must else c.rlike(rule.pattern)
        return F.when(there, rows).otherwise(F.array().cast("array<struct<ent:string,start:int,label:string>>"))

    return F.concat(*[one(r) for r in rules])


def with_patterns(docs: DataFrame, rules: tuple[Rule, ...] = RULES, weight: float = REGEX_WEIGHT, signal: str = "regex", text: str = "text", key: str = "doc_id", near: int = NEAR) -> DataFrame:
    """Votes for the matches of every rule, one scan for all."""
    c = F.col(text)
    rows = docs.select(key, F.explode_outer(matches(c, rules, near)).alias("m")).where("m is not null")
    ent = F.col("m.ent")
    return rows.select(key, ent.alias("ent"), F.col("m.start").alias("start"), (F.col("m.start") + F.length(ent)).alias("end"), F.col("m.label").alias("label"), F.lit(signal).alias("signal"), vote(ent, weight).alias("weight"))


# ---- dictionary ------------------------------------------------------------------------------------


def dictionary_key(words: Column, strip: str = tx.STRIP) -> Column:
    """Words as a dictionary has them: joined by underscores, lower case, hyphens too become underscores."""
    return F.replace(F.lower(F.btrim(F.array_join(words, "_"), F.lit(strip))), F.lit("-"), F.lit("_"))


def ngrams(docs: DataFrame, most: int = NGRAM, text: str = "text", compat: bool = False) -> DataFrame:
    """(doc_id, i, n, key, first, last, start, end) of all word n-grams up to ``most`` words; exact offsets of the stripped words.

    ``compat``: the last word of a text never begins an n-gram.
    """
    toks = F.coalesce(found(F.col(text), "(?U)\\S+"), F.array().cast("array<struct<ent:string,start:int>>"))
    base = docs.select("doc_id", toks.alias("toks"))
    # a row carries the few words that begin at one place, never a text's whole list
    windows = F.transform("toks", lambda _, i: F.struct(i.alias("i"), F.slice("toks", i + 1, F.lit(most)).alias("w")))
    windows = F.slice(windows, F.lit(1), F.greatest(F.size(windows) - 1, F.lit(0))) if compat else windows
    base = base.select("doc_id", F.explode_outer(windows).alias("g")).where("g is not null").select("doc_id", "g.i", "g.w")
    base = base.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("w"))))
    tok, last = F.get("w", F.lit(0)), F.get("w", F.col("n") - 1)
    words = F.transform(F.slice("w", F.lit(1), F.col("n")), lambda x: x["ent"])
    lead = F.length(tok["ent"]) - F.length(F.ltrim(tok["ent"], F.lit(tx.STRIP)))
    tail = F.length(last["ent"]) - F.length(F.rtrim(last["ent"], F.lit(tx.STRIP)))
    short = F.length(last["ent"]).isin(2, 3) & last["ent"].endswith(".")  # U.S. keeps its full stop
    return base.select("doc_id", "i", "n", dictionary_key(words).alias("key"), tok["ent"].alias("first"), last["ent"].alias("last"), (tok["start"] + lead).alias("start"), (last["start"] + F.length(last["ent"]) - F.when(short, F.greatest(tail - 1, F.lit(0))).otherwise(tail)).alias("end"))


def known_ngrams(docs: DataFrame, keys: frozenset[str], most: int = NGRAM, compat: bool = False) -> DataFrame:
    """The rows of ``ngrams`` whose key is in ``keys``, and their text ``ent``, in one Arrow pass: only words that some key begins with are looked at more closely.

    A worker holds one text at a time besides the batch as it came, and hands its hits on before the next text once there are HITS of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    strip = tx.STRIP
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("i int, n int, key string, first string, last string, start int, end int, ent string").fields])
    arrow = to_arrow_schema(schema)

    def hits(text: str, known: frozenset, heads: set):
        toks = [(m.group(), m.start()) for m in re.finditer(r"\S+", text)]
        for i, (tok, at) in enumerate(toks[:-1] if compat else toks):
            bare = tok.lstrip(strip)
            if bare:
                head = bare.lower().replace("-", "_").split("_", 1)[0]
                if head not in heads and head.rstrip(strip) not in heads:
                    continue
            for n in range(1, min(most, len(toks) - i) + 1):
                key = "_".join(t for t, _ in toks[i : i + n]).strip(strip).lower().replace("-", "_")
                if key in known:
                    last, last_at = toks[i + n - 1]
                    tail = len(last) - len(last.rstrip(strip))
                    tail = max(tail - 1, 0) if len(last) in (2, 3) and last.endswith(".") else tail  # U.S. keeps its full stop
                    start, end = at + len(tok) - len(bare), last_at + len(last) - tail
                    yield i, n, key, tok, last, start, end, text[start:end]

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        heads = {k.split("_", 1)[0] for k in known}
        for b in batches:
            rows = []
            for d, t in zip(b.column(0), b.column(1)):
                if t.is_valid:
                    rows += [(d.as_py(), *h) for h in hits(t.as_py(), known, heads)]
                if len(rows) >= HITS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def dictionary_hits(docs: DataFrame, dictionary: DataFrame, stopwords: DataFrame | None = None, most: int = NGRAM, compat: bool = False) -> DataFrame:
    """n-grams that are in ``dictionary`` (key, label). With ``stopwords`` (word), none begins or ends with one, and none is made of them alone.

    The keys of a dictionary of up to BROADCAST_KEYS are sent to the texts; a larger one is joined with the n-grams.
    """
    keys = [r[0] for r in dictionary.select("key").where("key is not null").distinct().limit(BROADCAST_KEYS + 1).collect()]
    rows = known_ngrams(docs, frozenset(keys), most, compat) if len(keys) <= BROADCAST_KEYS else ngrams(docs, most, compat=compat)
    rows = rows.join(dictionary, "key")
    if stopwords is None:
        return rows
    stop = stopwords.select(F.col("word").alias("w")).distinct()
    head = F.lower(F.ltrim(F.col("first"), F.lit(tx.STRIP)))
    rows = rows.withColumn("head", head).withColumn("tail", F.lower("last"))
    rows = rows.join(stop, F.col("head") == F.col("w"), "left_anti").join(stop, F.col("tail") == F.col("w"), "left_anti")
    return rows.join(stop, F.col("key") == F.col("w"), "left_anti").drop("head", "tail")


def with_dictionary(docs: DataFrame, dictionary: DataFrame, stopwords: DataFrame | None = None, labels: tuple[str, ...] | None = ("PERSON", "PUBLIC_FIGURE"), weight: float = DICTIONARY_WEIGHT, signal: str = "dictionary",
                    rename: dict[str, str] | None = None, most: int = NGRAM, caps: bool = True, collapse: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """Votes (no length factor) for the longest dictionary entry at each word, from left to right; words of a match take no further part.

    An entry of another label than ``labels`` (None: any) takes up its words too where it has fewer than 20 characters. Names of persons,
    organisations and places need capitals at both ends. Labels in ``collapse`` join neighbours of the same label into one mention.
    Only hits are grouped by document, never n-grams.
    """
    hits = dictionary_hits(docs, dictionary, stopwords, most, compat)
    label = reduce(lambda rest, x: F.when(F.col("label") == x[0], x[1]).otherwise(rest), (rename or {}).items(), F.col("label"))
    hits = hits.withColumn("label", label)
    wanted = F.lit(True) if labels is None else F.col("label").isin(*labels)
    capital = lambda c: F.left(c, F.lit(1)) == F.upper(F.left(c, F.lit(1)))
    named = reduce(lambda a, b: a | b, [F.contains(F.col("label"), F.lit(x)) for x in CAPITALISED])
    ok = (F.lit(not caps) | ~named | (capital(F.col("first")) & capital(F.col("last")))) if caps else F.lit(True)
    hits = hits.withColumn("take", wanted & ok).withColumn("block", ~wanted & (F.length("key") < OPEN_LENGTH)).where("take or block")
    known = "ent" in hits.columns and not collapse  # else the text has to be met again
    entry = F.struct("i", (-F.col("n")).alias("m"), "label", "start", "end", "take", (F.col("ent") if known else F.lit(None).cast("string")).alias("ent"))
    lists = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    kind = "struct<upto:int,got:array<struct<start:int,end:int,label:string,ent:string>>>"
    seed = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,end:int,label:string,ent:string>>").alias("got")).cast(kind)

    def step(acc: Column, h: Column) -> Column:
        mention = F.struct(h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"), h["ent"].alias("ent"))
        got = acc["got"]
        last = F.try_element_at(got, F.lit(-1))
        joined = h["label"].isin(*collapse) & (last["label"] == h["label"]) & (h["start"] - last["end"]).between(0, 1) if collapse else F.lit(False)
        longer = F.array_append(F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(0))), F.struct(last["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"), h["ent"].alias("ent")))
        grown = F.when(~h["take"], got).when(F.coalesce(joined, F.lit(False)), longer).otherwise(F.array_append(got, mention))
        return F.when(h["i"] >= acc["upto"], F.struct((h["i"] - h["m"]).alias("upto"), grown.alias("got"))).otherwise(acc).cast(kind)

    rows = lists.select("doc_id", F.explode_outer(F.aggregate("hits", seed, step, lambda a: a["got"])).alias("m")).where("m is not null").select("doc_id", "m.*")
    if known:
        return rows.select("doc_id", "ent", "start", "end", "label", F.lit(signal).alias("signal"), F.lit(weight).alias("weight"))
    texts = rows.drop("ent").join(docs.select("doc_id", "text"), "doc_id")
    return texts.select("doc_id", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("ent"), "start", "end", "label", F.lit(signal).alias("signal"), F.lit(weight).alias("weight"))


def public_figures(mentions: DataFrame, back_weight: float = 1.0) -> DataFrame:
    """Of dictionary votes only those for public figures of several words."""
    return mentions.where((F.col("label") == "PUBLIC_FIGURE") & F.contains(F.trim("ent"), F.lit(" "))).withColumn("weight", F.col("weight") * back_weight)


def expand_public_figures(votes: DataFrame, weight: float = 1.0) -> DataFrame:
    """Votes PUBLIC_FIGURE ('pf-expand') for persons whose mention shares a word of over four characters with a public figure of the document.

    An equi-join on the document with a prefix condition; mentions inside the span that the word is from, or that are public figures themselves, get none.
    """
    mention = ["doc_id", "ent", "start", "end"]
    kinds = votes.groupBy(*mention).agg(F.max((F.col("label") == "PUBLIC_FIGURE").cast("int")).alias("famous"), F.max((F.col("label") == "PERSON").cast("int")).alias("person"))
    famous = kinds.where("famous = 1").select("doc_id", F.col("start").alias("fs"), F.col("end").alias("fe"), F.explode(F.split(F.btrim("ent", F.lit(".")), " ")).alias("word"))
    famous = famous.where(F.length(F.btrim("word", F.lit(".,"))) > 4)
    words = famous.groupBy("doc_id", "word").agg(F.collect_list(F.struct("fs", "fe")).alias("spans"))
    other = kinds.where("famous = 0 and person = 1")
    ent, word = F.col("ent"), F.col("word")
    akin = (ent == word) | ent.startswith(word) | ((F.length(ent) > 4) & word.startswith(ent))
    inside = F.exists("spans", lambda s: (s["fs"] <= F.col("start")) & (s["fe"] >= F.col("end")))
    return other.join(words, "doc_id").where(akin & ~inside).groupBy(*mention).agg((F.count("*") * F.lit(weight)).alias("weight")).select(*mention, F.lit("PUBLIC_FIGURE").alias("label"), F.lit("pf-expand").alias("signal"), "weight")


def name_candidates(votes: DataFrame) -> DataFrame:
    """(doc_id, ent, start, end, candidate, asked): mentions of persons and public figures that a name model may be asked about.

    Not those that end in a one-letter word, nor an initial with one word. ``asked`` is in title case where the mention is all capitals or all small.
    """
    name = F.btrim("ent", F.lit("."))
    people = votes.where(F.col("label").isin("PERSON", "PUBLIC_FIGURE")).select("doc_id", "ent", "start", "end", name.alias("candidate")).distinct()
    words = tx.words(F.col("candidate"))
    initial = (F.size(words) == 2) & (F.length(F.btrim(F.get(words, F.lit(0)), F.lit("."))) == 1)
    plain = tx.script(F.col("candidate")).isNull()
    fit = ~plain | ((F.size(words) > 0) & (F.length(F.try_element_at(words, F.lit(-1))) != 1) & ~initial)
    flat = plain & ((F.col("candidate") == F.upper("candidate")) | (F.col("candidate") == F.lower("candidate")))
    return people.where(fit).withColumn("asked", F.when(flat, F.array_join(F.transform(words, lambda w: F.when(F.length(w) > 1, F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1_000)))).otherwise(w)), " ")).otherwise(F.col("candidate")))


def common_names(votes: DataFrame, scores: DataFrame, weight: float = 1.0) -> DataFrame:
    """Votes PUBLIC_FIGURE ('name-model') from ``scores`` (asked, matched, score, cutoff) of a language model: single words, and names of
    up to three characters in scripts without spaces, must score at most half of the cutoff."""
    rows = name_candidates(votes).join(scores, "asked").where("matched")
    wide = tx.script(F.col("asked")).isNotNull()
    brief = F.when(wide, F.length("asked") <= 3).otherwise(~F.contains("asked", F.lit(" ")))
    rows = rows.where(~brief | (F.col("score") <= F.col("cutoff") / 2))
    return rows.select("doc_id", "ent", "start", "end", F.lit("PUBLIC_FIGURE").alias("label"), F.lit("name-model").alias("signal"), F.lit(weight).alias("weight"))


# ---- questions -------------------------------------------------------------------------------------


def question_label(question: Column, answer: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """The label that a question word gives to its answer; null if none."""
    w = tx.words(F.replace(F.replace(F.btrim(F.lower(question), F.lit("?")), F.lit("'s"), F.lit(" 's")), F.lit("  "), F.lit(" ")))
    at = lambda k: F.get(w, F.lit(k))
    genitive = F.array_position(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), "'s") > 0
    life = F.arrays_overlap(w, F.array(*[F.lit(x) for x in ("born", "died", "birthday", "birthdate")]))
    stop = at(1).isin(*stopwords) if stopwords else F.lit(False)
    return (
        F.when((at(0) == "who") & answer.endswith("s"), "ORG").when((at(0) == "who") & genitive, "MISC").when(at(0) == "who", "PERSON").when(at(0) == "where", "LOC")
        .when((at(0) == "when") & life, "AGE").when(at(0) == "when", "DATE").when(at(0) == "why", "EVENT")
        .when((at(0) == "how") & at(1).isin("much", "many"), "ORDINAL").when(at(0) == "how", "EVENT").when(at(0).isin("which", "what") & at(1).isNotNull() & ~stop, "MISC")
    )


def from_questions(docs: DataFrame, votes: DataFrame, answers: DataFrame, weight: float = 1.0, signal: str = "qg", stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Votes for the answers of ``answers`` (doc_id, question, answer): to mentions that begin like the answer or that it begins with, or else to every place of it in the text."""
    asked = answers.select("doc_id", "question", "answer", question_label(F.col("question"), F.col("answer"), stopwords).alias("label")).where("label is not null and answer <> ''")
    known = votes.select("doc_id", "ent", "start", "end").distinct()
    meets = (F.col("ent").startswith(F.col("answer"))) | F.col("answer").startswith(F.col("ent"))
    matched = asked.join(known, "doc_id").where(meets)
    missing = asked.join(matched.select("doc_id", "question", "answer").distinct(), ["doc_id", "question", "answer"], "left_anti")
    places = missing.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.col("answer").alias("ent"), F.explode(occurrences(F.col("text"), F.col("answer"))).alias("start"), "label")
    every = matched.select("doc_id", "ent", "start", "end", "label").unionByName(places.select("doc_id", "ent", "start", (F.col("start") + F.length("ent")).alias("end"), "label"))
    return every.groupBy("doc_id", "ent", "start", "end", "label").agg((F.count("*") * F.lit(weight)).alias("weight")).withColumn("signal", F.lit(signal)).select("doc_id", "ent", "start", "end", "label", "signal", "weight")


def relations(votes: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, question, answer_start, answer_end, other_start, other_end): mentions that answer a question, with the mentions that it names."""
    known = votes.select("doc_id", "ent", "start", "end").distinct()
    meets = (F.col("ent").startswith(F.col("answer"))) | F.col("answer").startswith(F.col("ent"))
    left = answers.select("doc_id", F.lower("question").alias("question"), "answer").join(known, "doc_id").where(meets).select("doc_id", "question", F.col("start").alias("answer_start"), F.col("end").alias("answer_end"))
    right = known.select("doc_id", F.lower("ent").alias("low"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return left.join(right, "doc_id").where(F.contains("question", F.col("low"))).drop("low")


def occurrences(c: Column, part: Column) -> Column:
    """Starts of all places of ``part`` in a text, none within another."""
    pieces = F.split(c, F.concat(F.lit("\\Q"), part, F.lit("\\E")))
    seed = F.array(F.lit(0))
    folded = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), seed, lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p) + F.when(F.size(acc) > 1, F.length(part)).otherwise(0)))
    return F.slice(folded, F.lit(2), F.size(folded))


def dictionary_frame(spark: SparkSession, entries: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(entries.items()), "key string, label string")
