"""Every query of the library by name, and its SQL. Queries run over whole tables; limits only where they are what is asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, tables
from ..functions import text as tx
from ..operators import align, detect, prompts, replace, votes
from ..sources import documents
from . import pipeline

LANGS = ("de", "en", "es", "fr")
DICTIONARY = {"apache_license": "LAW", "license": "LAW", "licensed_under": "LAW", "orre_orre": "PERSON", "eriner_thanea": "PUBLIC_FIGURE", "stteen_erachtz": "PUBLIC_FIGURE", "enststung_ench": "ORG", "the_the": "MISC"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quote(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quote, r)) + ')' for r in rows)}) AS t({names})"


def _mentions_sql(table: str = "documents", key: str = "doc_id", text: str = "text", rules: tuple = detect.RULES) -> str:
    """A subquery with (key, ent, start, label) for every rule's matches."""
    parts = []
    for r in rules:
        near = f"WHERE regexp_matches(substr({text}, greatest(start - {detect.NEAR}, 0) + 1, length(ent) + {detect.NEAR} + least(start, {detect.NEAR})), '{r.context}')" if r.context else ""
        parts.append(f"""SELECT {key}, '{r.label}' AS label, ent, start FROM (
  SELECT {key}, {text}, ms[i] AS ent, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM (
    SELECT {key}, {text}, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT {key}, {text}, regexp_extract_all({text}, '{r.pattern}') AS ms, string_split_regex({text}, '{r.pattern}') AS ps FROM {table}))) {near}""")
    return "(" + " UNION ALL ".join(parts) + ")"


WEIGHT_SQL = f"round({detect.REGEX_WEIGHT}::DOUBLE * (1.0::DOUBLE + length(ent)::DOUBLE / 100), 6)"
VOTES_SQL = f'SELECT doc_id, ent, start, start + length(ent) AS "end", label, \'regex\' AS signal, {WEIGHT_SQL} AS weight FROM {_mentions_sql()}'

# ---- detection -------------------------------------------------------------------------------------


@query(f'SELECT doc_id, ent, start, CAST(start + length(ent) AS INTEGER) AS "end", label FROM {_mentions_sql()}')
def pii_regex_mentions(spark, sf_dir):
    return detect.with_patterns(_read(spark, sf_dir, "documents")).select("doc_id", "ent", "start", "end", "label")


@query(f"SELECT doc_id, label, signal, round(sum(weight), 6) AS weight, count(*) AS n FROM ({VOTES_SQL}) GROUP BY ALL")
def pii_vote_weights(spark, sf_dir):
    return detect.with_patterns(_read(spark, sf_dir, "documents")).groupBy("doc_id", "label", "signal").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))


@query(f"SELECT lang, label, count(*) AS n, count(DISTINCT doc_id) AS docs, round(sum(weight), 4) AS weight FROM ({VOTES_SQL}) JOIN documents USING (doc_id) GROUP BY ALL")
def pii_counts_by_lang_label(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    found = detect.with_patterns(docs.withColumn("key", F.struct("doc_id", "lang")), key="key")
    return found.groupBy(F.col("key.lang").alias("lang"), "label").agg(F.count("*").alias("n"), F.countDistinct("key.doc_id").alias("docs"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"SELECT conv_id, turn, label, ent, start FROM {_mentions_sql('conversations', 'conv_id, turn')}")
def conversation_pii(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return detect.with_patterns(rows, key="key").select("key.conv_id", "key.turn", "label", "ent", "start")


@query(f"SELECT page_id, label, ent, start FROM {_mentions_sql('pages', 'page_id', 'html')}")
def page_text_pii(spark, sf_dir):
    return detect.with_patterns(_read(spark, sf_dir, "pages"), text="html", key="page_id").select("page_id", "label", "ent", "start")


def _dictionary(spark: SparkSession) -> DataFrame:
    return detect.dictionary_frame(spark, DICTIONARY)


STRIP_SQL = _quote(tx.STRIP)


@query(f"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT doc_id, i, n, w, replace(lower(trim(array_to_string(w[i:i + n - 1], '_'), {STRIP_SQL})), '-', '_') AS key FROM places, range(1, {detect.NGRAM + 1}) AS r(n) WHERE i + n - 1 <= len(w))
SELECT key, label, CAST(n AS INTEGER) AS n, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM grams JOIN {_values(DICTIONARY.items(), 'key, label')} USING (key) GROUP BY ALL""")
def dictionary_ngrams(spark, sf_dir):
    return detect.dictionary_hits(_read(spark, sf_dir, "documents"), _dictionary(spark)).groupBy("key", "label", "n").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


def _dictionary_sql(dictionary: dict, labels: tuple, stop: str | None = None, table: str = "documents") -> str:
    """A subquery with the votes of ``detect.with_dictionary``; ``stop``: a subquery of stopwords (word)."""
    capital = lambda c: f"left({c}, 1) = upper(left({c}, 1))"
    named = " OR ".join(f"contains(label, '{x}')" for x in detect.CAPITALISED)
    stops = f"AND lower(ltrim(first, {STRIP_SQL})) NOT IN ({stop}) AND lower(last) NOT IN ({stop}) AND key NOT IN ({stop})" if stop else ""
    return f"""(
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ms, string_split_regex(text, '\\S+') AS ps FROM {table}),
tok AS (SELECT doc_id, unnest(range(0, len(ms))) AS i, unnest(ms) AS tok, unnest(ps[1:len(ms)]) AS gap FROM cut),
placed AS (SELECT doc_id, i, tok, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i) - length(tok) AS start FROM tok),
windows AS (SELECT doc_id, i, list(tok) OVER w AS w, list(start) OVER w AS s FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {detect.NGRAM - 1} FOLLOWING)),
grams AS (SELECT doc_id, i, unnest(range(1, len(w) + 1)) AS n, w, s FROM windows),
keyed AS (SELECT doc_id, i, n, replace(lower(trim(array_to_string(w[1:n], '_'), {STRIP_SQL})), '-', '_') AS key, w[1] AS first, w[n] AS last, s[1] AS first_at, s[n] AS last_at FROM grams),
hits AS (SELECT *, first_at + length(first) - length(ltrim(first, {STRIP_SQL})) AS start, last_at + length(last) - CASE WHEN length(last) IN (2, 3) AND right(last, 1) = '.' THEN greatest(length(last) - length(rtrim(last, {STRIP_SQL})) - 1, 0) ELSE length(last) - length(rtrim(last, {STRIP_SQL})) END AS z,
    label IN ({', '.join(map(_quote, labels))}) AS wanted, NOT ({named}) OR ({capital('first')} AND {capital('last')}) AS ok
  FROM keyed JOIN {_values(dictionary.items(), 'key, label')} USING (key) WHERE true {stops}),
lists AS (SELECT doc_id, list([struct_pack(i := i, upto := i + n, label := label, start := start, z := z, take := wanted AND ok)] ORDER BY i, -n, label, start, z) AS h FROM hits WHERE (wanted AND ok) OR (NOT wanted AND length(key) < {detect.OPEN_LENGTH}) GROUP BY doc_id),
picked AS (SELECT doc_id, unnest(list_reduce(h, lambda acc, x: CASE WHEN x[1].i >= acc[-1].upto THEN acc || x ELSE acc END)) AS m FROM lists)
SELECT doc_id, substr(text, CAST(m.start AS INTEGER) + 1, CAST(m.z - m.start AS INTEGER)) AS ent, CAST(m.start AS INTEGER) AS start, CAST(m.z AS INTEGER) AS "end", m.label AS label, 'dictionary' AS signal, {detect.DICTIONARY_WEIGHT}::DOUBLE AS weight FROM picked JOIN {table} USING (doc_id) WHERE m.take)"""


def _expand_sql(votes: str) -> str:
    """A subquery with the votes of ``detect.expand_public_figures``."""
    return f"""(
WITH kinds AS (SELECT doc_id, ent, start, "end" AS z, bool_or(label = 'PUBLIC_FIGURE') AS famous, bool_or(label = 'PERSON') AS person FROM {votes} GROUP BY ALL),
words AS (SELECT doc_id, start AS fs, z AS fe, unnest(string_split(trim(ent, '.'), ' ')) AS word FROM kinds WHERE famous),
spans AS (SELECT doc_id, word, list(struct_pack(fs := fs, fe := fe)) AS spans FROM words WHERE length(trim(word, '.,')) > 4 GROUP BY doc_id, word)
SELECT k.doc_id, ent, start, z AS "end", 'PUBLIC_FIGURE' AS label, 'pf-expand' AS signal, count(*)::DOUBLE AS weight FROM kinds k JOIN spans s ON s.doc_id = k.doc_id
WHERE NOT famous AND person AND (starts_with(ent, word) OR (length(ent) > 4 AND starts_with(word, ent))) AND len(list_filter(spans, lambda s: s.fs <= start AND s.fe >= z)) = 0 GROUP BY ALL)"""


def _merge_sql(rows: str, table: str = "documents") -> str:
    """A subquery with the rows of ``votes.merge``: a fold over the sorted spans of each document."""
    span = lambda a, z, v: f"struct_pack(a := {a}, z := {z}, v := {v})"
    p, x, before = "acc[-1]", "x[1]", "acc[1:len(acc) - 1]"
    return f"""(
WITH spans AS (SELECT doc_id, start AS a, "end" AS z, list(struct_pack(label := label, signal := signal, weight := weight)) AS v FROM {rows} GROUP BY ALL),
lists AS (SELECT doc_id, list([{span('a', 'z', 'v')}] ORDER BY a, -z) AS s FROM spans GROUP BY doc_id),
folded AS (SELECT doc_id, unnest(list_reduce(s, lambda acc, x: CASE WHEN {p}.z <= {x}.a THEN acc || x
    WHEN {p}.z >= {x}.z OR {p}.z - {x}.a > {votes.OVERLAP} THEN {before} || [{span(f'{p}.a', f'greatest({p}.z, {x}.z)', f'{p}.v || {x}.v')}]
    WHEN {x}.z - {x}.a > {p}.z - {p}.a THEN {before} || [{span(f'{p}.a', f'{x}.a', f'{p}.v')}] || x
    ELSE acc || [{span(f'{p}.z', f'{x}.z', f'{x}.v')}] END)) AS s FROM lists),
raw AS (SELECT doc_id, substr(text, CAST(s.a AS INTEGER) + 1, CAST(s.z - s.a AS INTEGER)) AS raw, s.a AS a, unnest(s.v) AS v FROM folded JOIN {table} USING (doc_id) WHERE s.z > s.a),
stripped AS (SELECT doc_id, trim(raw, {STRIP_SQL}) AS ent, CAST(a + length(raw) - length(ltrim(raw, {STRIP_SQL})) AS INTEGER) AS start, v FROM raw)
SELECT doc_id, ent, start, CAST(start + length(ent) AS INTEGER) AS "end", v.label AS label, v.signal AS signal, round(sum(v.weight), 6) AS weight FROM stripped WHERE ent <> '' GROUP BY ALL)"""


STOP_WORDS_SQL = "SELECT word FROM " + _values([(w,) for w in sorted({w for x in LANGS for w in tables.stopwords()[x]})], "word")


@query(f"SELECT * FROM {_dictionary_sql(DICTIONARY, ('PERSON', 'PUBLIC_FIGURE', 'ORG', 'LAW'), STOP_WORDS_SQL)}")
def dictionary_mentions(spark, sf_dir):
    stop = tables.frame(spark, "stopwords").where(F.col("lang").isin(*LANGS)).select("word").distinct()
    return detect.with_dictionary(_read(spark, sf_dir, "documents"), _dictionary(spark), stop, labels=("PERSON", "PUBLIC_FIGURE", "ORG", "LAW"))


FIGURES = {"eriner_thanea": "PUBLIC_FIGURE", "eriner": "PERSON", "thanea": "PERSON", "stteen_erachtz": "PUBLIC_FIGURE", "erachtz": "PERSON"}


@query(f"WITH found AS {_dictionary_sql(FIGURES, ('PERSON', 'PUBLIC_FIGURE'))} SELECT * FROM {_expand_sql('found')}")
def pf_expand(spark, sf_dir):
    found = detect.with_dictionary(_read(spark, sf_dir, "documents"), detect.dictionary_frame(spark, FIGURES))
    return detect.expand_public_figures(found)


QUESTIONS = ("Who wrote it?", "Who is John's brother?", "Where is it?", "When was he born?", "When did it end?", "Why now?", "How many are there?", "How does it work?", "What city is it?", "Is it?")


@query(f"""
SELECT p_partkey, question, CASE WHEN question LIKE 'Who%' AND right(p_name, 1) = 's' THEN 'ORG' WHEN question LIKE 'Who is John%' THEN 'MISC' WHEN question LIKE 'Who%' THEN 'PERSON' WHEN question LIKE 'Where%' THEN 'LOC'
  WHEN question LIKE 'When%born%' THEN 'AGE' WHEN question LIKE 'When%' THEN 'DATE' WHEN question LIKE 'Why%' THEN 'EVENT' WHEN question LIKE 'How many%' THEN 'ORDINAL' WHEN question LIKE 'How%' THEN 'EVENT' WHEN question LIKE 'What%' THEN 'MISC' END AS label
FROM (SELECT p_partkey, p_name, [{', '.join(map(_quote, QUESTIONS))}][p_partkey % {len(QUESTIONS)} + 1] AS question FROM part)""")
def question_label(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").withColumn("question", F.get(F.lit(list(QUESTIONS)), (F.col("p_partkey") % len(QUESTIONS)).cast("int")))
    return rows.select("p_partkey", "question", detect.question_label(F.col("question"), F.col("p_name")).alias("label"))


# ---- text ------------------------------------------------------------------------------------------


def _replaces(c: str, pairs) -> str:
    for a, b in pairs:
        c = f"replace({c}, {_quote(a)}, {_quote(b)})"
    return c


NORMAL_SQL = _replaces("translate(text, '[]', '()')", tx._SPACING)


@query(f"SELECT doc_id, md5({NORMAL_SQL}) AS normal_md5, length({NORMAL_SQL}) AS n FROM documents")
def normalize_text(spark, sf_dir):
    n = tx.normalize(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("normal_md5"), F.length(n).cast("long").alias("n"))


@query(f"SELECT doc_id, md5(translate(text, {_quote(tx._FOLD_FROM)}, {_quote(tx._FOLD_TO)})) AS folded_md5 FROM documents")
def quote_fold(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.fold_quotes(F.col("text"))).alias("folded_md5"))


@query("SELECT doc_id, md5(translate(text, '0123456789', '1111111111')) AS masked_md5 FROM documents")
def digit_mask(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.mask_digits(F.col("text"))).alias("masked_md5"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{tx.EMOJI}', '', 'g')) AS plain_md5 FROM documents")
def emoji_strip(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.strip_emoji(F.col("text"))).alias("plain_md5"))


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN regexp_matches(text, {_quote(p)}) THEN {_quote(s)}' for s, p in tx.SCRIPTS)} END AS script, lang IN ({', '.join(map(_quote, tx.CJK_LANGS))}) AS cjk FROM documents")
def script_detect(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.script(F.col("text")).alias("script"), tx.is_cjk(F.col("lang")).alias("cjk"))


@query("SELECT lang, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) ::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY lang")
def tokenize_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(tx.tokens(F.col("text"), F.col("lang")))).alias("tokens"), F.count("*").alias("docs"))


@query()
def sentence_aware_chunks(spark, sf_dir):
    return tx.chunks(_read(spark, sf_dir, "documents"))


@query()
def chunks_rejoined(spark, sf_dir):
    joined = tx.join_chunks(tx.chunks(_read(spark, sf_dir, "documents")))
    return joined.select("doc_id", "lang", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# ---- languages -------------------------------------------------------------------------------------

_STOP = [(x, w) for x in LANGS for w in sorted(tables.stopwords()[x])]
STOP_SQL = _values(_STOP, "lang, word")
UNITS_SQL = "SELECT doc_id, lang AS own, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents"
BEST_SQL = f"""SELECT d.doc_id, coalesce(b, struct_pack(lang := NULL::VARCHAR, score := 0::DOUBLE)) AS b FROM documents d LEFT JOIN (
  SELECT doc_id, arg_min(struct_pack(lang := lang, score := hits / units), struct_pack(h := -hits, l := lang)) AS b FROM (
    SELECT doc_id, lang, count(*) AS hits, max(units) AS units FROM (SELECT doc_id, len(w) AS units, unnest(w) AS word FROM ({UNITS_SQL})) JOIN {STOP_SQL} USING (word) GROUP BY doc_id, lang) GROUP BY doc_id) USING (doc_id)"""


@query(f"""
WITH u AS (SELECT doc_id, own, len(w) AS units, unnest(w) AS word FROM ({UNITS_SQL})),
hits AS (SELECT doc_id, count(*) AS hits FROM u JOIN {STOP_SQL} ON t.word = u.word AND t.lang = u.own GROUP BY doc_id)
SELECT d.doc_id, d.own AS lang, CASE WHEN len(w) > 0 THEN round(coalesce(hits, 0) / len(w), 6) END AS score FROM ({UNITS_SQL}) d LEFT JOIN hits USING (doc_id)""")
def stopword_score(spark, sf_dir):
    return language.stopword_score(_read(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, b.lang AS best_lang, round(b.score, 6) AS score FROM ({BEST_SQL})")
def lang_argmax(spark, sf_dir):
    return language.best_language(_read(spark, sf_dir, "documents"), LANGS).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, lang, b.lang AS best_lang, round(CASE WHEN (b.lang <> lang OR (b.score > 0.4 AND b.score < 0.7)) AND b.lang = lang THEN b.score * 1.5 ELSE b.score END, 6) AS score FROM ({BEST_SQL}) JOIN documents USING (doc_id)")
def lang_agreement_boost(spark, sf_dir):
    rows = language.with_best_language(_read(spark, sf_dir, "documents"), LANGS).select("doc_id", "lang", "best.best_lang", "best.score")
    return rows.select("doc_id", "lang", "best_lang", F.round(language.agreed_score(F.col("best_lang"), F.col("score"), F.col("lang")), 6).alias("score"))


@query(f"SELECT lang, count(*) AS members, string_agg(member, ' ' ORDER BY member) AS names FROM {_values(tables.grouped_languages(), 'lang, member')} GROUP BY lang")
def lang_group_members(spark, sf_dir):
    return language.group_table(spark).groupBy("lang").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("member")), " ").alias("names"))


_COUNTRIES = sorted((r["country"], r["rank"], r["lang"]) for r in tables.table("country_languages").to_pylist())


@query(f"SELECT d.lang, country, rank, count(*) AS docs FROM documents d JOIN {_values(_COUNTRIES, 'country, rank, lang')} ON t.lang = d.lang GROUP BY ALL")
def country_languages(spark, sf_dir):
    table = tables.frame(spark, "country_languages")
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs")).join(table, "lang").select("lang", "country", "rank", "docs")


@query(f"SELECT t.lang, country, docs FROM {_values(sorted((r['lang'], r['country'], r['rank']) for r in tables.table('language_countries').to_pylist()), 'lang, country, rank')} JOIN (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) USING (lang)")
def language_countries(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs")).join(tables.frame(spark, "language_countries"), "lang").select("lang", "country", "docs")


@query(f"""
WITH has AS (SELECT doc_id, max(CASE WHEN label IN ('EMAIL', 'ID') THEN 1 ELSE 0 END) AS p FROM {_mentions_sql()} GROUP BY doc_id),
marked AS (SELECT d.doc_id, coalesce(p = 1, true) OR ('0x' || substr(md5('7:' || d.doc_id), 1, 8))::BIGINT % 4 = 0 AS keep FROM documents d LEFT JOIN has USING (doc_id))
SELECT doc_id FROM marked WHERE keep OR NOT (SELECT bool_or(keep) FROM marked)""")
def person_filter(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return language.keep_persons(docs, detect.with_patterns(docs), 3, ("EMAIL", "ID")).select("doc_id")


# ---- sources ---------------------------------------------------------------------------------------


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () // 4 AS size FROM documents) WHERE r >= size AND r < 2 * size")
def shard_2_of_4(spark, sf_dir):
    return documents.shard(_read(spark, sf_dir, "documents"), 2, 4).select("doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS batch FROM documents")
def batch_25(spark, sf_dir):
    return documents.batches(_read(spark, sf_dir, "documents")).select("doc_id", "batch")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 30")
def ordered_cutoff(spark, sf_dir):
    return documents.limited(_read(spark, sf_dir, "documents"), 30).select("doc_id", "lang")


@query("""
SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, min(doc_id) FILTER (doc_id % 3 <> 0) AS first_id, max(doc_id) FILTER (doc_id % 3 <> 0) + count(*) FILTER (doc_id % 3 = 0) AS last_id FROM documents""")
def assign_ids(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("id"))
    return documents.assign_ids(rows).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f'SELECT doc_id, ent, start, CAST("end" AS INTEGER) AS "end", label, signal, weight FROM ({VOTES_SQL})')
def serialize_roundtrip(spark, sf_dir):
    packed = documents.pack_votes(detect.with_patterns(_read(spark, sf_dir, "documents")))
    back = packed.select("doc_id", documents.from_json_arrays(documents.to_json_arrays(F.col("ner"))).alias("ner"))
    return documents.unpack_votes(back)


# ---- votes -----------------------------------------------------------------------------------------

_KINDS = ("PERSON", "PUBLIC_FIGURE", "LOC", "ADDRESS", "DATE", "AGE", "ID", "CARDINAL")
LINE_SQL = f"""(SELECT l_orderkey AS doc_id, 'm' || (l_partkey % 2) AS ent, CAST(l_partkey % 2 AS INTEGER) AS start, CAST(l_partkey % 2 + 2 AS INTEGER) AS "end",
  [{', '.join(map(_quote, _KINDS))}][l_suppkey % {len(_KINDS)} + 1] AS label, l_returnflag AS signal, l_quantity AS weight FROM lineitem)"""
ROLL_SQL = f'(SELECT doc_id, ent, start, "end", label, round(sum(weight), 6) AS weight FROM {LINE_SQL} GROUP BY ALL)'


def _line_votes(spark, sf_dir) -> DataFrame:
    """Votes made of order lines: many labels and signals on the same few spans."""
    k = (F.col("l_partkey") % 2).cast("int")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("m"), k.cast("string")).alias("ent"), k.alias("start"), (k + 2).alias("end"), F.get(F.lit(list(_KINDS)), (F.col("l_suppkey") % len(_KINDS)).cast("int")).alias("label"), F.col("l_returnflag").alias("signal"), F.col("l_quantity").alias("weight"))


@query(f"SELECT * FROM {ROLL_SQL}")
def signal_rollup(spark, sf_dir):
    return votes.roll_up(_line_votes(spark, sf_dir))


def _rules_sql() -> str:
    steps = [f"s0 AS (SELECT doc_id, start, {', '.join(f'''sum(weight) FILTER (label = '{x}') AS {x}''' for x in _KINDS)} FROM {ROLL_SQL} GROUP BY doc_id, start)"]
    for k, (goes, gets) in enumerate(votes.RULES):
        other = gets or "DATE"
        both = f"({goes} IS NOT NULL AND {other} IS NOT NULL)"
        cols = [f"CASE WHEN NOT {both} THEN {x} END AS {x}" if x == goes else f"CASE WHEN {both} THEN {x} + {goes} ELSE {x} END AS {x}" if x == gets else x for x in _KINDS]
        steps.append(f"s{k + 1} AS (SELECT doc_id, start, {', '.join(cols)} FROM s{k})")
    last = f"s{len(votes.RULES)}"
    rows = " UNION ALL ".join(f"SELECT doc_id, start, '{x}' AS label, {x} AS weight FROM {last} WHERE {x} IS NOT NULL" for x in _KINDS)
    return f"WITH {', '.join(steps)} SELECT doc_id, 'm' || start AS ent, start, CAST(start + 2 AS INTEGER) AS \"end\", label, round(weight, 6) AS weight FROM ({rows})"


@query(_rules_sql())
def hyponym_collapse(spark, sf_dir):
    return votes.collapse_labels(votes.roll_up(_line_votes(spark, sf_dir)))


@query(f'SELECT doc_id, ent, start, "end", arg_min(label, struct_pack(w := -weight, l := label)) AS label FROM {ROLL_SQL} GROUP BY ALL')
def label_choice(spark, sf_dir):
    return votes.choose_label(votes.roll_up(_line_votes(spark, sf_dir)))


@query(f"SELECT ancestor, count(*) AS n, round(sum(weight), 2) AS weight FROM {ROLL_SQL} r JOIN {_values(tables.ontology(), 'label, ancestor')} USING (label) GROUP BY ancestor")
def ontology_expand(spark, sf_dir):
    return votes.expand_labels(votes.roll_up(_line_votes(spark, sf_dir))).groupBy("ancestor").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


@query(f"SELECT label, signal, grouping(label, signal) ::INTEGER AS level, count(*) AS n, round(sum(weight), 2) AS weight FROM {LINE_SQL} GROUP BY CUBE (label, signal)")
def vote_report(spark, sf_dir):
    return _line_votes(spark, sf_dir).cube("label", "signal").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


@query("""
WITH v AS (SELECT o_orderkey AS doc_id, (o_custkey % 130)::VARCHAR AS ent, 'ID' AS label FROM orders)
SELECT ent, count(*) AS n FROM v WHERE NOT (length(ent) < 4 AND ent::DOUBLE <> 0) AND length(ent) > 1 GROUP BY ent UNION ALL
SELECT 'w' || (o_custkey % 7), count(*) FROM orders GROUP BY ALL""")
def mention_cleanup(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    make = lambda c: orders.select(F.col("o_orderkey").alias("doc_id"), c.alias("ent"), F.lit(0).alias("start"), F.length(c).alias("end"), F.lit("ID").alias("label"), F.lit("x").alias("signal"), F.lit(1.0).alias("weight"))
    every = make((F.col("o_custkey") % 130).cast("string")).unionByName(make(F.concat(F.lit("w"), (F.col("o_custkey") % 7).cast("string"))))
    return votes.clean(every, spark.createDataFrame([("and",)], "word string")).groupBy("ent").agg(F.count("*").alias("n"))


WIDE_RULES = (detect.Rule("ADDRESS", "[A-Z][a-z]+ [a-z]+ [a-z]+"), detect.Rule("PERSON", "[A-Z][a-z]+"), *detect.RULES)


@query(f"""WITH v AS (SELECT doc_id, ent, start, start + length(ent) AS "end", label, 'regex' AS signal, {WEIGHT_SQL} AS weight FROM {_mentions_sql(rules=WIDE_RULES)}) SELECT * FROM {_merge_sql('v')}""")
def overlap_merge(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return votes.merge(docs, detect.with_patterns(docs, WIDE_RULES))


NORMAL_DOCS_SQL = f"(SELECT doc_id, lang, {NORMAL_SQL} AS text FROM (SELECT doc_id, coalesce(lang, 'en') AS lang, coalesce(text, {_quote(tx.MISSING)}) AS text FROM documents))"
_SUMMED = 'SELECT doc_id, ent, start, "end", label, signal, round(sum(weight), 6) AS weight FROM {} GROUP BY ALL'


def _clean_sql(rows: str) -> str:
    number = "regexp_matches(trim(ent), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') AND coalesce(try_cast(trim(ent) AS DOUBLE), 0) <> 0"
    return f"(SELECT * FROM {rows} WHERE NOT (length(ent) < 4 AND {number}) AND NOT (length(ent) <= 1 AND NOT regexp_matches(ent, '{'|'.join(p for _, p in tx.SCRIPTS)}')))"


def _best_sql(merged: str) -> str:
    """A subquery with the spans of ``merged`` and their labels after roll-up, label rules and choice."""
    named = sorted({x for goes, gets in votes.RULES for x in (goes, gets or "DATE")})
    span = 'doc_id, ent, start, "end"'
    sums = ", ".join(f"sum(weight) FILTER (label = '{x}') AS {x}" for x in named)
    steps = [f"rolled AS (SELECT {span}, label, round(sum(weight), 6) AS weight FROM {merged} GROUP BY ALL)", f"s0 AS (SELECT {span}, {sums} FROM rolled GROUP BY ALL)"]
    for k, (goes, gets) in enumerate(votes.RULES):
        both = f"({goes} IS NOT NULL AND {gets or 'DATE'} IS NOT NULL)"
        cols = [f"CASE WHEN NOT {both} THEN {x} END AS {x}" if x == goes else f"CASE WHEN {both} THEN round({x} + {goes}, 6) ELSE {x} END AS {x}" if x == gets else x for x in named]
        steps.append(f"s{k + 1} AS (SELECT {span}, {', '.join(cols)} FROM s{k})")
    rows = " UNION ALL ".join(f"SELECT {span}, '{x}' AS label, {x} AS weight FROM s{len(votes.RULES)} WHERE {x} IS NOT NULL" for x in named)
    rows += f" UNION ALL SELECT {span}, label, weight FROM rolled WHERE label NOT IN ({', '.join(map(_quote, named))})"
    pick = "struct_pack(w := -weight, l := label)"
    return f"(WITH {', '.join(steps)} SELECT {span}, arg_min(label, {pick}) AS label, arg_min(weight, {pick}) AS weight FROM ({rows}) GROUP BY ALL)"


def _rewritten_sql(spans: str, table: str, text: str, new: str) -> str:
    """A subquery (doc_id, body, z, n): texts up to the last of ``spans`` with each replaced by ``new``, the end of that one, their number."""
    return f"""(WITH k AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(lag("end") OVER w, 0) AS upto FROM {spans} WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", ent))
SELECT doc_id, string_agg(substr({text}, CAST(upto AS INTEGER) + 1, CAST(start - upto AS INTEGER)) || {new}, '' ORDER BY k) AS body, max("end") AS z, CAST(count(*) AS INTEGER) AS n FROM k JOIN {table} USING (doc_id) GROUP BY doc_id)"""


@query(f"""
WITH docs AS {NORMAL_DOCS_SQL},
regex AS (SELECT doc_id, ent, start, start + length(ent) AS "end", label, 'regex' AS signal, {WEIGHT_SQL} AS weight FROM {_mentions_sql('docs')}),
dict AS (SELECT * FROM {_dictionary_sql(DICTIONARY, ('PERSON', 'PUBLIC_FIGURE'), table='docs')} WHERE label = 'PUBLIC_FIGURE' AND contains(trim(ent), ' ')),
found AS ({_SUMMED.format(_clean_sql('(SELECT * FROM regex UNION ALL SELECT * FROM dict)'))}),
more AS ({_SUMMED.format(f"(SELECT * FROM found UNION ALL SELECT * FROM {_expand_sql('found')})")})
SELECT * FROM {_best_sql(_merge_sql('more', 'docs'))}""")
def ner_collapse(spark, sf_dir):
    return pipeline.entities(pipeline.normalized(_read(spark, sf_dir, "documents")), pipeline.Options(dictionary=_dictionary(spark)))


# ---- replacement -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5(regexp_replace(text, '{detect.RULES[0].pattern}', '<EMAIL>', 'g')) AS masked_md5 FROM documents")
def mask_in_scope(spark, sf_dir):
    return replace.mask_patterns(_read(spark, sf_dir, "documents"), ("EMAIL",)).select("doc_id", F.md5("text_masked").alias("masked_md5"))


@query(f"""
WITH docs AS {NORMAL_DOCS_SQL},
regex AS (SELECT doc_id, ent, start, start + length(ent) AS "end", label, 'regex' AS signal, {WEIGHT_SQL} AS weight FROM {_mentions_sql('docs')}),
found AS ({_SUMMED.format(_clean_sql('regex'))}), best AS (SELECT * FROM {_best_sql(_merge_sql('found', 'docs'))})
SELECT d.doc_id, lang, CASE WHEN body IS NULL THEN text ELSE body || substr(text, CAST(z AS INTEGER) + 1) END AS text_anon, coalesce(n, 0) AS mentions
FROM docs d LEFT JOIN {_rewritten_sql('best', 'docs', 'text', "'<' || label || '>'")} r ON r.doc_id = d.doc_id""")
def anonymized_text(spark, sf_dir):
    scope = ("EMAIL", "ID", "IP_ADDRESS", "KEY", "PERSON", "PHONE")
    return pipeline.process(_read(spark, sf_dir, "documents"), pipeline.Options(scope=scope)).select("doc_id", "lang", "text_anon", F.size("ner_anon").alias("mentions"))


def _pick_sql(values, key: str, salt: str) -> str:
    return f"[{', '.join(map(_quote, values))}][('0x' || substr(md5('0:{salt}:' || {key}), 1, 8))::BIGINT % {len(values)} + 1]"


@query(f"SELECT c_custkey, {_pick_sql(replace._COUNTRIES, 'lower(c_name)', 'country')} AS country, {_pick_sql(replace._COMPANIES, '''CASE WHEN length(split_part(lower(c_name), ' ', 1)) > 4 THEN split_part(lower(c_name), ' ', 1) ELSE lower(c_name) END''', 'company')} || ' ' || {_pick_sql(replace._FORMS, 'lower(c_name)', 'form')} AS company FROM customer")
def keyed_fake_names(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", replace.fake_country(F.col("c_name")).alias("country"), replace.fake_company(F.col("c_name")).alias("company"))


PERSON_LANGS = ("en", "vi", "ca", "bn", "yo", "ur", "zh", "xh")


@query()  # its SQL stands with the other rules
def keyed_fake_persons(spark, sf_dir):
    langs = list(PERSON_LANGS)
    return _read(spark, sf_dir, "customer").select("c_custkey", replace.fake_person(F.concat(F.lit("Ana "), F.col("c_name")), F.get(F.lit(langs), (F.col("c_custkey") % len(langs)).cast("int"))).alias("person"))


@query(f"""
WITH v AS ({VOTES_SQL}), spans AS (SELECT DISTINCT doc_id, ent, start, "end" FROM {_merge_sql('v')}), plain AS (SELECT doc_id, translate(text, '()', '{{}}') AS plain FROM documents)
SELECT p.doc_id, CASE WHEN body IS NULL THEN plain ELSE replace(body || substr(plain, CAST(z AS INTEGER) + 1), '  ', ' ') END AS marked, n
FROM plain p LEFT JOIN {_rewritten_sql('spans', 'plain', 'plain', "' ' || k || ' [ ' || translate(ent, '()', '{}') || ' ] '")} r ON r.doc_id = p.doc_id""")
def marked_items(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return replace.mark_items(docs, votes.merge(docs, detect.with_patterns(docs)).select(*votes.SPAN).distinct()).select("doc_id", "marked", F.size("items").alias("n"))


# ---- translation, similarity, questions ------------------------------------------------------------

_MODELS = sorted((r["src"], r["tgt"], r["model"]) for r in tables.table("translation_models").to_pylist())


@query(f"WITH m AS (SELECT * FROM {_values([(a, b) for a, b, _ in _MODELS], 'src, tgt')}) SELECT DISTINCT a.src, a.tgt AS mid, b.tgt FROM m a JOIN m b ON a.tgt = b.src WHERE a.src <> b.tgt AND a.src <> a.tgt AND b.src <> b.tgt AND NOT EXISTS (SELECT 1 FROM m c WHERE c.src = a.src AND c.tgt = b.tgt)")
def mt_route_pivot(spark, sf_dir):
    return align.pivots(spark)


@query(f"SELECT lang AS src, 'en' AS tgt, docs, coalesce(model, '{align.MANY_TO_MANY}') AS model FROM (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) LEFT JOIN {_values(_MODELS, 'src, tgt, model')} ON src = lang AND tgt = 'en'")
def mt_route(spark, sf_dir):
    pairs = _read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("src")).agg(F.count("*").alias("docs")).withColumn("tgt", F.lit("en"))
    return align.route(pairs).select("src", "tgt", "docs", "model")


COSINE_SQL = "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(COSINE_SQL)
def cosine_pairs(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    return e.join(b, "vec_id").select("vec_id", F.round(align.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"), (F.col("label") == F.col("other_label")).alias("same"))


@query(f"SELECT vec_id, cosine >= 0.75 AS translate, cosine >= 0.5 AS augment, cosine >= 0.7 AS back FROM ({COSINE_SQL})")
def similarity_gate(spark, sf_dir):
    rows = cosine_pairs(spark, sf_dir)
    return rows.select("vec_id", *[language.similar_enough(F.col("cosine"), u).alias(u) for u in ("translate", "augment", "back")])


@query(f"SELECT doc_id, best_lang = 'en' AS kept, CASE WHEN best_lang = 'en' OR best_lang IS NULL THEN length(text) ELSE {len(tx.MISSING)} END AS n FROM documents JOIN (SELECT doc_id, b.lang AS best_lang FROM ({BEST_SQL})) USING (doc_id)")
def language_gate(spark, sf_dir):
    rows = language.with_best_language(_read(spark, sf_dir, "documents"), LANGS).select("doc_id", "text", "best.best_lang")
    return rows.select("doc_id", (F.col("best_lang") == "en").alias("kept"), F.length(language.gate(F.col("text"), F.col("best_lang"), F.lit("en"))).cast("long").alias("n"))


@query()
def align_score(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", align.aligned("text", "other", F.lit("en"))["score"].alias("score"))


@query("SELECT item_id, 'question: What is it?  context: ' || text || ' </s>' AS qa, 'generate questions: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' </s>' AS e2e FROM benchmark")
def question_prompts(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", prompts.qa_prompt(F.lit("What is it?"), F.col("text")).alias("qa"), prompts.end_to_end_prompt(F.col("text")).alias("e2e"))


@query("""
WITH s AS (SELECT item_id AS doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS s FROM benchmark),
one AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM s)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS sentence_no, 'extract answers: ' || array_to_string(list_transform(s, lambda x, i: CASE WHEN i = k THEN '<hl> ' || x || ' <hl>' ELSE x END), ' ') || ' </s>' AS prompt FROM one""")
def answer_prompts(spark, sf_dir):
    return prompts.answer_prompts(_read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))


from . import rules  # noqa: E402, F401
