"""Replacement of mentions: masks, invented names that are the same wherever a name recurs, placeholders for translation.

Invented values are functions of (mention, seed), read from fixed lists by an md5 key: no memory of what was replaced before is needed, so
documents can be rewritten in any order on any executor, and a lost task gives the same text again. Two modes of rewriting: by offset (the
default, a fold within the row), and by text (``compat``), which finds mentions by their words as the published rule does.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, tables
from ..functions import text as tx

ANONYMIZE, AUGMENT = ("PERSON", "ID"), ("ADDRESS", "ORG", "PERSON", "LOC", "ID")
WIDE = ("zh", "ja", "ko", "th")
#: Languages with name lists of their own: (first names of men, of women, middle names of men and women or none, surnames).
_LISTS = {
    "bn": "bengali", "pa": "punjabi", "gu": "gujurati", "ca": "catalan", "yo": "yoruba", "ur": "urdu", "vi": "vietnamese",
    **dict.fromkeys(("mr", "sw", "sn", "st", "ig", "ny", "xh", "zu"), "bantu"),
}
_FIRST = "Alba Anton Carmen Clara David Elena Emil Eva Felix Hugo Irene Jonas Julia Laura Leo Marta Nora Oscar Paula Rita Simon Sofia Theo Vera".split()
_LAST = "Adler Bauer Castell Duran Ferrer Garner Holm Ibarra Keller Lange Marchand Navarro Olsen Prado Quist Roth Serrano Thorne Ulrich Vidal Weber Ziegler".split()
_WIDE_FIRST, _WIDE_LAST = "伟 芳 娜 敏 静 磊 洋 艳 勇 杰".split(), "王 李 张 刘 陈 杨 赵 黄 周 吴".split()
_COMPANIES, _FORMS = "Arden Brook Calder Dunmore Elmwood Farrow Glenby Harlow Ivory Kestrel Larch Mossley Norden Orwell Penrose Quarry".split(), "Group Ltd Partners Sons Works".split()
_STATES = "Avonshire Brenland Calvera Dornia Estmark Falden Greyholm Harvia Istria Kelland Lorin Marlow Norvale Ostend Pellam Quill".split()
_PROVINCES = "河北省 山西省 辽宁省 吉林省 江苏省 浙江省 安徽省 福建省 江西省 山东省".split()
_STREETS = "Ash Birch Cedar Elm Hazel Linden Maple Oak Poplar Rowan Walnut Willow".split()
_COUNTRIES = "Belgium Chile Denmark Estonia Finland Ghana Iceland Jordan Kenya Latvia Malta Norway Oman Peru Qatar Senegal".split()


def number(key: Column, salt: str, seed: int | Column = 0) -> Column:
    """A number in [0, 2**32) from a text; the same in any engine that has md5."""
    head = [seed.cast("string"), F.lit(f":{salt}:")] if isinstance(seed, Column) else [F.lit(f"{seed}:{salt}:")]
    return F.conv(F.substring(F.md5(F.concat(*head, key)), 1, 8), 16, 10).cast("long")


def pick(values: list[str] | tuple[str, ...], key: Column, salt: str, seed: int = 0) -> Column:
    # one literal text, split once when the plan is optimised: a list of literals would make plans of thousands of nodes
    return F.get(F.split(F.lit("|".join(values)), "[|]"), F.pmod(number(key, salt, seed), F.lit(len(values))).cast("int"))


def name_lists(lang: str) -> dict[str, tuple[str, ...]]:
    """first_male, first_female, last, and for Vietnamese middle_first_male and so on, of a language; a list for all others where it has none."""
    kind, all_lists = _LISTS.get(lang), tables.name_lists()
    if kind is None:
        first, last = (_WIDE_FIRST, _WIDE_LAST) if lang in ("zh", "ja", "ko", "th") else (_FIRST, _LAST)
        return {"first_male": tuple(first), "first_female": tuple(first), "last": tuple(last)}
    male = all_lists.get(f"{kind}_firstnames_male") or all_lists[f"{kind}_firstnames"]
    female = all_lists.get(f"{kind}_firstnames_female") or male
    out = {"first_male": male, "first_female": female, "last": all_lists[f"{kind}_surnames"]}
    for sex in ("male", "female"):
        for k in ("first", "second"):
            if middle := all_lists.get(f"{kind}_{k}_middlenames_{sex}"):
                out[f"middle_{k}_{sex}"] = middle
    return out


def _by_language(lang: Column, langs, make) -> Column:
    """``make(language)`` by the row's language, one branch for each kind of list."""
    kinds: dict[str | None, list[str]] = {}
    for x in langs:
        kinds.setdefault(_LISTS.get(x, "wide" if x in WIDE else None), []).append(x)
    default = make("en")
    return reduce(lambda rest, k: F.when(lang.isin(*kinds[k]), make(kinds[k][0])).otherwise(rest), [k for k in kinds if k], default)


LANGUAGES = (*_LISTS, *WIDE)


def fake_person(ent: Column, lang: Column, last_words: Column | None = None, seed: int = 0, female: Column | None = None) -> Column:
    """An invented name. A first word has the same invented first name everywhere, a last word the same surname; titles that end in a full stop don't count.

    ``last_words``: the surnames that the document has, in lower case; a single word among them gets a surname. ``female``: which first names to take (else by the key).
    """
    ws = tx.words(ent)
    plain = F.filter(ws, lambda w: ~w.endswith("."))
    ws = tx.let(F.struct(ws.alias("all"), plain.alias("plain")), lambda x: F.when(F.size(x["plain"]) > 0, x["plain"]).otherwise(x["all"]))
    surnames = last_words if last_words is not None else F.array().cast("array<string>")

    def make(x: str, head: Column, tail: Column, single: Column) -> Column:
        lists = name_lists(x)
        woman = female if female is not None else number(head, "sex", seed) % 2 == 1
        by_sex = lambda men, women, key, salt: pick(men, key, salt, seed) if men == women else F.when(woman, pick(women, key, salt, seed)).otherwise(pick(men, key, salt, seed))
        first, last = by_sex(lists["first_male"], lists["first_female"], head, "first"), pick(lists["last"], tail, "last", seed)
        if x in WIDE:
            whole = F.concat(pick(lists["last"], F.left(ent, F.lit(1)), "last", seed), pick(lists["first_male"], F.substring(ent, 2, 10), "first", seed))
            return F.when(F.length(ent) > 1, whole).otherwise(pick(lists["last"], ent, "last", seed))
        if x == "vi":  # surname first; each middle name in half of the cases
            middle = [F.when(number(F.lower(ent), f"some{k}", seed) % 2 == 1, by_sex(lists[f"middle_{k}_male"], lists[f"middle_{k}_female"], F.lower(ent), f"middle{k}")) for k in ("first", "second")]
            whole = F.concat_ws(" ", last, *middle, first)
        else:
            whole = F.concat_ws(" ", first, last)
        return F.when(single & F.array_contains(surnames, head), last).when(single, first).otherwise(whole)

    ends = tx.let(ws, lambda w: F.struct(F.lower(F.get(w, F.lit(0))).alias("head"), F.lower(F.try_element_at(w, F.lit(-1))).alias("tail"), (F.size(w) <= 1).alias("single")))
    return tx.let(ends, lambda e: _by_language(lang, LANGUAGES, lambda x: make(x, e["head"], e["tail"], e["single"])))


def fake_company(ent: Column, seed: int = 0) -> Column:
    """Companies whose first word (of over four letters) is the same share the first word of their invented name."""
    head = F.lower(F.get(F.split(ent, " "), F.lit(0)))
    key = F.when(F.length(head) > 4, head).otherwise(F.lower(ent))
    return F.concat_ws(" ", pick(_COMPANIES, key, "company", seed), pick(_FORMS, F.lower(ent), "form", seed))


def fake_state(ent: Column, lang: Column, seed: int = 0) -> Column:
    return F.when(lang == "zh", pick(_PROVINCES, F.lower(ent), "state", seed)).otherwise(pick(_STATES, F.lower(ent), "state", seed))


def fake_country(ent: Column, seed: int = 0) -> Column:
    return pick(_COUNTRIES, F.lower(ent), "country", seed)


def fake_address(ent: Column, lang: Column, seed: int = 0) -> Column:
    key = F.lower(ent)
    return F.concat((number(key, "house", seed) % 200 + 1).cast("string"), F.lit(" "), pick(_STREETS, key, "street", seed), F.lit(" Street, "), fake_state(ent, lang, seed))


def fake_email(ent: Column, seed: int = 0) -> Column:
    key = F.lower(ent)
    return F.concat(F.lower(pick(_FIRST, key, "mail", seed)), F.lit("."), F.lower(pick(_LAST, key, "mail2", seed)), (number(key, "mail3", seed) % 100).cast("string"), F.lit("@example.com"))


def fake_ssn(ent: Column, seed: int = 0) -> Column:
    """Nine digits in the form of a number that is never given out (it begins with 9)."""
    n = number(F.lower(ent), "ssn", seed)
    return F.concat(F.lit("9"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.floor(n / 100) % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.floor(n / 10_000) % 10_000).cast("string"), 4, "0"))


def replacement(ent: Column, label: Column, lang: Column, scope: tuple[str, ...] = ANONYMIZE, values: bool = False, last_words: Column | None = None, seed: int = 0) -> Column:
    """What stands for a mention; null where it stays. Persons, organisations, places and addresses get invented values, others their label in angle brackets.

    Public figures stay. ``values``: numbers keep their shape with every digit a 1, user names and addresses are invented too.
    """
    shaped = F.when(F.lit(values), F.when(label.isin("IP_ADDRESS", "ID", "PHONE"), tx.mask_digits(ent)).when(label == "KEY", "KEY-11111").when(label == "LICENSE_PLATE", "LP-11111").when(label == "EMAIL", fake_email(ent, seed)).when(label == "USER", F.concat(F.lit("@"), F.split_part(fake_email(ent, seed), F.lit("@"), F.lit(1)))))
    tag = F.concat(F.lit("<"), label, F.lit(">"))
    chosen = F.when(label == "PERSON", fake_person(ent, lang, last_words, seed)).when(label == "ORG", fake_company(ent, seed)).when(label == "LOC", fake_state(ent, lang, seed)).when(label == "ADDRESS", fake_address(ent, lang, seed)).when(label != "PUBLIC_FIGURE", F.coalesce(shaped, tag))
    return F.when(label.isin(*scope), chosen)


def rewrite(c: Column, spans: Column) -> Column:
    """struct<text, spans>: a text with spans (array<struct<start, end, label, new>>, not overlapping) replaced by ``new`` (null: kept), and where they are then."""
    kind = "struct<text:string,at:int,spans:array<struct<ent:string,start:int,end:int,label:string>>>"
    seed = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.array().cast("array<struct<ent:string,start:int,end:int,label:string>>").alias("spans")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        upto = F.concat(acc["text"], F.substring(c, acc["at"] + 1, s["start"] - acc["at"]))
        new = F.coalesce(s["new"], F.substring(c, s["start"] + 1, s["end"] - s["start"]))
        mention = F.struct(new.alias("ent"), F.length(upto).alias("start"), (F.length(upto) + F.length(new)).alias("end"), s["label"].alias("label"))
        done = F.struct(F.concat(upto, new).alias("text"), s["end"].alias("at"), F.array_append(acc["spans"], mention).alias("spans"))
        return F.when(s["start"] >= acc["at"], done).otherwise(acc).cast(kind)

    return F.aggregate(F.array_sort(spans), seed, step, lambda a: F.struct(F.concat(a["text"], F.substring(c, a["at"] + 1, F.length(c))).alias("text"), a["spans"].alias("spans")))


def anonymize(docs: DataFrame, entities: DataFrame, scope: tuple[str, ...] = ANONYMIZE, values: bool = False, seed: int = 0, compat: bool = False) -> DataFrame:
    """doc_id, lang, text_anon, ner_anon (array<struct<ent, start, end, label>>) and context (map of mention to its replacement) of every document of ``docs`` (doc_id, lang, text).

    ``entities``: doc_id, ent, start, end, label. They alone are grouped, and joined to the documents once.
    """
    surname = F.when((F.col("label") == "PERSON") & (F.size(tx.words(F.col("ent"))) > 1), F.lower(F.try_element_at(F.filter(tx.words(F.col("ent")), lambda w: ~w.endswith(".")), F.lit(-1))))
    lists = entities.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "ent")).alias("spans"), F.collect_set(surname).alias("surnames"))
    rows = docs.select("doc_id", "lang", "text").join(lists, "doc_id", "left")
    empty = F.array().cast("array<struct<start:int,end:int,label:string,ent:string>>")
    rows = rows.withColumn("spans", F.coalesce("spans", empty)).withColumn("surnames", F.coalesce("surnames", F.array().cast("array<string>")))
    made = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["ent"].alias("ent"), replacement(s["ent"], s["label"], F.col("lang"), scope, values, F.col("surnames"), seed).alias("new")))
    rows = rows.withColumn("made", made)
    changed = F.filter("made", lambda s: s["new"].isNotNull())
    context = F.map_from_entries(F.array_distinct(F.transform(changed, lambda s: F.struct(s["ent"], s["new"]))))
    if compat:
        out = _by_text("text", "lang", F.transform("made", lambda s: F.struct(s["ent"].alias("ent"), s["label"].alias("label"), s["new"].alias("new"))))
    else:
        out = rewrite(F.col("text"), F.transform("made", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["new"].alias("new"))))
    return rows.select("doc_id", "lang", out.alias("o"), context.alias("context")).select("doc_id", "lang", F.col("o.text").alias("text_anon"), F.col("o.spans").alias("ner_anon"), "context")


def by_text(text: str, lang: str | None, mentions: list[dict]) -> tuple[str, list[tuple]]:
    """The published rule on one text: longest mention first, found by its words, not by its place; then the results are found again."""
    wide = lang in WIDE
    ranked = sorted(mentions, key=lambda m: -len(m["ent"]))
    for k, m in enumerate(ranked):
        if m["new"] is None:
            continue
        parts = m["ent"].split(" ")
        if m["label"] == "PERSON" and not wide:
            parts = parts[1:] if parts[0].endswith(".") else parts
            parts = parts[:-1] if parts and parts[-1].endswith(".") else parts
        sought, mark = " ".join(parts) or m["ent"], f"<{k}>"
        text = text.replace(f"{sought} ", f"{mark} ").replace(f" {sought}", f" {mark}")
        text = text.replace(sought, mark) if len(sought) > 5 else text
    results: list[tuple[str, str]] = []
    for k, m in enumerate(ranked):
        if m["new"] is None:
            results.append((m["ent"], m["label"]))
            continue
        spaced = m["new"].startswith("<") or not wide
        pair = (f" {m['new']} " if m["new"].startswith("<") else m["new"], m["label"])
        if pair not in results:
            results.append(pair)
        text = text.replace(f"<{k}>", f" {m['new']} " if spaced else m["new"])
    text = text.replace("  ", " ").strip()
    left, spans = text, []
    for ent, label in sorted(results, key=lambda r: -len(r[0])):
        at = left.find(ent) if ent else -1
        while at >= 0:
            spans.append((ent, at, at + len(ent), label))
            at = left.find(ent, at + len(ent) + 1)
        left = left.replace(ent, " " * len(ent)) if ent else left
    return text, sorted(spans, key=lambda s: s[1])


def by_text_rows(text: pd.Series, lang: pd.Series, mentions: pd.Series) -> pd.DataFrame:
    rows = [by_text(t or "", x, [dict(m) for m in ms]) for t, x, ms in zip(text, lang, mentions)]
    return pd.DataFrame({"text": [t for t, _ in rows], "spans": [[dict(zip(("ent", "start", "end", "label"), s)) for s in spans] for _, spans in rows]})


_by_text = arrow.udf(__name__, "by_text_rows", "struct<text:string,spans:array<struct<ent:string,start:int,end:int,label:string>>>")


def mask(docs: DataFrame, entities: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """doc_id, text_masked: every mention in scope as its label in angle brackets."""
    lists = entities.where(F.col("label").isin(*scope)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", F.concat(F.lit("<"), "label", F.lit(">")).alias("new"))).alias("spans"))
    rows = docs.select("doc_id", "text").join(lists, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(rewrite(F.col("text"), F.col("spans"))["text"]).alias("text_masked"))


def mask_patterns(docs: DataFrame, scope: tuple[str, ...], rules: tuple | None = None) -> DataFrame:
    """doc_id, text_masked: the same for the pattern rules in scope, found and rewritten within the row, so texts are neither joined nor shuffled."""
    from .detect import RULES, matches

    c = F.col("text")
    spans = F.transform(matches(c, tuple(r for r in rules or RULES if r.label in scope)), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["ent"])).alias("end"), m["label"].alias("label"), F.concat(F.lit("<"), m["label"], F.lit(">")).alias("new")))
    return docs.select("doc_id", "text", spans.alias("spans")).select("doc_id", F.when(F.size("spans") > 0, rewrite(c, F.col("spans"))["text"]).otherwise(c).alias("text_masked"))


def adopt(docs: DataFrame, anonymized: DataFrame) -> DataFrame:
    """``docs`` with the anonymized text as text where there is one."""
    rows = docs.join(anonymized.select("doc_id", "text_anon"), "doc_id", "left")
    return rows.withColumn("text", F.coalesce("text_anon", "text")).select(*docs.columns)


def without_known(names: DataFrame, known: DataFrame, trials: int = 8, most: int = 1_000, seed: int = 0) -> DataFrame:
    """``names`` (ent, lang) with an invented name ``new`` that ``known`` (name) doesn't have: that of the first seed which gives one; after ``most`` seeds the last one.

    Names for which ``trials`` seeds were not enough are tried again with ten times as many, and only those. A list of known names stands for
    the language model by which names of public figures are told.
    """
    taken = known.select(F.col("name").alias("new")).distinct().withColumn("taken", F.lit(True))
    left, done, first, upto = names.select("ent", "lang").distinct(), None, 0, min(trials, most)
    while True:
        tries = left.select("ent", "lang", F.explode(F.sequence(F.lit(first), F.lit(upto - 1))).alias("k"))
        rows = tries.withColumn("new", fake_person(F.col("ent"), F.col("lang"), None, F.col("k") + seed)).join(taken, "new", "left")
        free = F.min_by("new", F.when(F.col("taken").isNull(), F.col("k")))
        best = rows.groupBy("ent", "lang").agg(free.alias("new"), F.max_by("new", "k").alias("other"))
        found = best.select("ent", "lang", F.coalesce("new", "other").alias("new")) if upto == most else best.where("new is not null").select("ent", "lang", "new")
        done = found if done is None else done.unionByName(found)
        left = best.where("new is null").select("ent", "lang")
        if upto == most or left.isEmpty():
            return done
        first, upto = upto, min(10 * upto, most)


# ---- placeholders ----------------------------------------------------------------------------------


def mark_items(docs: DataFrame, entities: DataFrame, left: str = "[", right: str = "]") -> DataFrame:
    """doc_id, marked, items: every mention as ``number [ mention ]`` in its place, the numbers counting the mentions by start. Round brackets become curly ones.

    By offset: a mention's own place is marked, and others of the same words are not.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "ent")))
    lists = entities.groupBy("doc_id").agg(ordered.alias("items"))
    rows = docs.select("doc_id", "text").join(lists, "doc_id", "left")
    spans = F.transform("items", lambda m, k: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("").alias("label"), F.concat(F.lit(" "), k.cast("string"), F.lit(f" {left} "), F.translate(m["ent"], "()", "{}"), F.lit(f" {right} ")).alias("new")))
    plain = F.translate("text", "()", "{}")
    marked = F.when(F.col("items").isNull(), plain).otherwise(F.replace(rewrite(plain, spans)["text"], F.lit("  "), F.lit(" ")))
    return rows.select("doc_id", marked.alias("marked"), "items")


def stable_hash(value: str) -> int:
    """The key of ``number`` in plain Python, for tests."""
    return int(hashlib.md5(value.encode()).hexdigest()[:8], 16)
