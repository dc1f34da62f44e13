"""Queries for rules that need mentions, links or questions as input, with their SQL. Inputs that no table has are made of the rows of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, tables
from ..functions import text as tx
from ..operators import align, detect, prompts, replace, votes
from ..sources import documents, shared
from ..streaming import documents as streams
from .registry import LINE_SQL, PERSON_LANGS, SQL, VOTES_SQL, _line_votes, _mentions_sql, _pick_sql, _quote, _read, _replaces, _values, query


# ---- sources and sinks -----------------------------------------------------------------------------

ROWS_SQL = "SELECT doc_id, lang, md5(text) AS text_md5, length(text) AS n FROM documents"


def _digest(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").cast("long").alias("doc_id"), "lang", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


def _with_id(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang", F.lit("web").alias("domain"))


@query(ROWS_SQL)
def json_lines_round_trip(spark, sf_dir):
    path = shared.new_folder(spark)
    documents.write_json_lines(_with_id(spark, sf_dir), path)
    return _digest(documents.read_json_lines(spark, path).where("_corrupt_record is null"))


@query(ROWS_SQL)
def json_lines_by_language(spark, sf_dir):
    path = shared.new_folder(spark)
    documents.write_json_lines(_with_id(spark, sf_dir), path, by_language=True)
    return _digest(documents.read_documents(spark, path, "json"))


@query(ROWS_SQL)
def gzip_round_trip(spark, sf_dir):
    path = documents.default_path(shared.new_folder(spark), "en")
    _with_id(spark, sf_dir).write.option("compression", "gzip").json(path)
    return _digest(documents.read_json_lines(spark, path))


@query(ROWS_SQL)
def parquet_mirror(spark, sf_dir):
    return _digest(documents.read_documents(spark, f"{sf_dir}/documents.parquet").withColumn("id", F.col("doc_id")))


@query("SELECT doc_id, coalesce(lang, 'en') AS lang, '' AS domain, md5(coalesce(text, ' . . . ')) AS text_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents)")
def missing_defaults(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return documents.with_defaults(docs, "en").select("doc_id", "lang", "domain", F.md5("text").alias("text_md5"))


# ---- streams ---------------------------------------------------------------------------------------


def _drained(spark, sf_dir, table: str, plan) -> DataFrame:
    """What ``plan`` gives of a table that is read as a stream, written once as JSON lines."""
    schema, out = _read(spark, sf_dir, table).schema, shared.new_folder(spark)
    made = plan(streams.read_folder(spark, f"{sf_dir}/{table}.parquet", schema))
    streams.write_json(made, out, f"{out}-state").awaitTermination()
    return spark.read.schema(made.schema).json(out)


@query(f'SELECT doc_id, ent, start, CAST(start + length(ent) AS INTEGER) AS "end", label FROM {_mentions_sql()}')
def streamed_mentions(spark, sf_dir):
    return _drained(spark, sf_dir, "documents", streams.votes).select("doc_id", "ent", "start", "end", "label")


@query("""
WITH e AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS w, event_type, value FROM events)
SELECT epoch_us(w) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e
GROUP BY w, event_type HAVING w + INTERVAL 1 hour <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 2 hour FROM events)""")
def streamed_counts(spark, sf_dir):
    """Windows that the watermark (two hours behind the last event) has passed."""
    return _drained(spark, sf_dir, "events", streams.counts).select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH steps AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events),
numbered AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM steps)
SELECT user_id, epoch_us(min(ts)) // 1000 AS session_start, epoch_us(max(ts) + INTERVAL 30 minute) // 1000 AS session_end, count(*) AS n FROM numbered
GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 minute <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 2 hour FROM events)""")
def streamed_sessions(spark, sf_dir):
    """Sessions that the watermark has passed; JSON keeps thousandths of a second."""
    rows = _drained(spark, sf_dir, "events", streams.sessions)
    return rows.select("user_id", F.unix_millis("session_start").alias("session_start"), F.unix_millis("session_end").alias("session_end"), "n")


# ---- text ------------------------------------------------------------------------------------------


@query("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS words FROM part")
def subword_merge(spark, sf_dir):
    """Names cut into pieces of three letters come together again."""
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / 3).cast("int")), lambda k: F.concat(F.when(k == 0, "▁").otherwise(""), F.substring(w, k * 3 + 1, F.lit(3))))
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.flatten(F.transform(F.filter(F.split("p_name", " "), lambda w: w != ""), pieces)).alias("pieces"))
    return rows.select("p_partkey", F.array_join(tx.merge_subwords(F.col("pieces")), "|").alias("words"))


@query(f"SELECT lang, CAST(max(length(word)) AS INTEGER) AS max_len FROM {_values(sorted((x, w) for x, ws in tables.stopwords().items() for w in ws), 'lang, word')} GROUP BY lang")
def longest_stopword(spark, sf_dir):
    return language.longest_stopword(spark)


@query(f"SELECT doc_id, md5(regexp_replace(substr(replace(lower(text), chr(10), ' '), 1, 1000), '{tx.EMOJI}', '', 'g')) AS shown_md5 FROM documents")
def identifier_input(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(language.clipped(F.col("text"))).alias("shown_md5"))


@query(f"SELECT c_custkey, rank, lang FROM (SELECT c_custkey, ['fr', 'ch', 'in', 'zz', 'ng', 'cn', 'es'][c_nationkey % 7 + 1] AS country FROM customer) JOIN {_values(sorted((r['country'], r['rank'], r['lang']) for r in tables.table('country_languages').to_pylist()), 'country, rank, lang')} USING (country)")
def customer_languages(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.get(F.lit(["fr", "ch", "in", "zz", "ng", "cn", "es"]), (F.col("c_nationkey") % 7).cast("int")).alias("country"))
    return language.countries(rows).select("c_custkey", "rank", "lang")


# ---- mentions --------------------------------------------------------------------------------------

_NAMES = "SELECT c_custkey AS doc_id, {ent} AS ent, c_nationkey AS start, CASE WHEN c_custkey % 3 = 0 THEN 'PERSON' ELSE 'PUBLIC_FIGURE' END AS label, c_acctbal AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey"
_ENT_SQL = "CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name || ' ' || c_mktsegment WHEN 2 THEN 'R. ' || n_name WHEN 3 THEN n_name || ' B' ELSE lower(n_name || ' ' || c_mktsegment) || '.' END"
NAMES_SQL = f"({_NAMES.format(ent=_ENT_SQL)})"


def _names(spark, sf_dir) -> DataFrame:
    """Names made of nations and market segments, as votes."""
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_custkey").alias("doc_id"), F.expr(_ENT_SQL).alias("ent"), F.col("c_nationkey").cast("int").alias("start"), F.when(F.col("c_custkey") % 3 == 0, "PERSON").otherwise("PUBLIC_FIGURE").alias("label"), F.col("c_acctbal").alias("weight"))
    return rows.select("doc_id", "ent", "start", (F.col("start") + F.length("ent")).alias("end"), "label", F.lit("dictionary").alias("signal"), "weight")


@query(f"SELECT doc_id, ent, start, label, round(weight * 0.5, 6) AS weight FROM {NAMES_SQL} WHERE label = 'PUBLIC_FIGURE' AND contains(trim(ent), ' ')")
def public_figure_votes(spark, sf_dir):
    found = detect.public_figures(_names(spark, sf_dir), 0.5)
    return found.select("doc_id", "ent", "start", "label", F.round("weight", 6).alias("weight"))


_TITLE = "array_to_string(list_transform(string_split(candidate, ' '), lambda w: CASE WHEN length(w) > 1 THEN upper(w[1]) || lower(w[2:]) ELSE w END), ' ')"
ASKED_SQL = f"""(SELECT doc_id, ent, start, CASE WHEN candidate = upper(candidate) OR candidate = lower(candidate) THEN {_TITLE} ELSE candidate END AS asked
  FROM (SELECT DISTINCT doc_id, ent, start, trim(ent, '.') AS candidate FROM {NAMES_SQL})
  WHERE length(string_split(candidate, ' ')[-1]) <> 1 AND NOT (len(string_split(candidate, ' ')) = 2 AND length(trim(string_split(candidate, ' ')[1], '.')) = 1))"""


@query(f"SELECT doc_id, ent, start, asked FROM {ASKED_SQL}")
def name_candidates(spark, sf_dir):
    return detect.name_candidates(_names(spark, sf_dir)).select("doc_id", "ent", "start", "asked")


@query(f"SELECT doc_id, ent, start, 'PUBLIC_FIGURE' AS label, 0.8::DOUBLE AS weight FROM {ASKED_SQL} WHERE length(asked) % 5 <> 0 AND (contains(asked, ' ') OR length(asked) % 8 <= 4)")
def name_model_votes(spark, sf_dir):
    """A language model's scores stand for by numbers made of the names' lengths."""
    found = _names(spark, sf_dir)
    n = F.length("asked")
    scores = detect.name_candidates(found).select("asked").distinct().select("asked", (n % 5 != 0).alias("matched"), (n % 8).cast("double").alias("score"), F.lit(8.0).alias("cutoff"))
    return detect.common_names(found, scores, 0.8).select("doc_id", "ent", "start", "label", "weight")


_RELATED = "SELECT n_nationkey AS doc_id, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"""
WITH n AS ({_RELATED}), known AS (SELECT doc_id, n_name AS ent, 0 AS start FROM n UNION SELECT doc_id, r_name, 50 FROM n),
asked AS (SELECT doc_id, 'which region has ' || lower(n_name) || '?' AS question, r_name AS answer FROM n UNION ALL SELECT doc_id, 'where is ' || lower(r_name) || '?', substr(n_name, 1, 4) FROM n)
SELECT a.doc_id, question, k.start AS answer_start, CAST(k.start + length(k.ent) AS INTEGER) AS answer_end, o.start AS other_start, CAST(o.start + length(o.ent) AS INTEGER) AS other_end
FROM asked a JOIN known k ON a.doc_id = k.doc_id AND (starts_with(k.ent, answer) OR starts_with(answer, k.ent)) JOIN known o ON o.doc_id = a.doc_id AND contains(question, lower(o.ent))""")
def question_relations(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("doc_id"), "n_name", "r_name")
    mention = lambda c, at: rows.select("doc_id", F.col(c).alias("ent"), F.lit(at).alias("start"), (F.length(c) + at).alias("end"), F.lit("LOC").alias("label"))
    asked = rows.select("doc_id", F.concat(F.lit("Which region has "), "n_name", F.lit("?")).alias("question"), F.col("r_name").alias("answer"))
    asked = asked.unionByName(rows.select("doc_id", F.concat(F.lit("Where is "), "r_name", F.lit("?")).alias("question"), F.left("n_name", F.lit(4)).alias("answer")))
    return detect.relations(mention("n_name", 0).unionByName(mention("r_name", 50)), asked)


# ---- votes across languages ------------------------------------------------------------------------

SUMMED_SQL = f'(SELECT doc_id, ent, start, "end", label, signal, round(sum(weight), 6) AS weight FROM {LINE_SQL} GROUP BY ALL)'
_OTHER = "CASE l_partkey % 4 WHEN 0 THEN 'north sea' WHEN 1 THEN 'sea' WHEN 2 THEN 'north' ELSE 'The' END"
_LINK = "CASE l_suppkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'the' ELSE 'sea' END"
LINKS_SQL = f"(SELECT DISTINCT l_orderkey AS doc_id, CAST(l_partkey % 2 AS INTEGER) AS start, CAST(l_partkey % 2 + 2 AS INTEGER) AS \"end\", {_LINK} AS other_ent FROM lineitem)"
OTHER_SQL = f"(SELECT DISTINCT l_orderkey AS doc_id, {_OTHER} AS oe, CASE WHEN l_linenumber % 4 = 0 THEN 'MISC' ELSE ['PERSON', 'LOC', 'DATE'][l_linenumber % 3 + 1] END AS ol, l_returnflag AS os FROM lineitem)"


def _links(spark, sf_dir) -> DataFrame:
    k = (F.col("l_partkey") % 2).cast("int")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), k.alias("start"), (k + 2).alias("end"), F.expr(_LINK).alias("other_ent")).distinct()


@query(f"""
WITH met AS (SELECT l.*, oe, ol, os, oe = other_ent AS same FROM {LINKS_SQL} l JOIN {OTHER_SQL} o USING (doc_id)
  WHERE oe = other_ent OR (length(other_ent) > 3 AND (contains(oe, other_ent) OR (length(oe) > 3 AND contains(other_ent, oe))))),
best AS (SELECT *, bool_or(same) OVER (PARTITION BY doc_id, start, "end", other_ent) AS any_same FROM met)
SELECT doc_id, ent, v.start, v."end", v.label, v.signal, round(CASE WHEN EXISTS (SELECT 1 FROM best b WHERE b.doc_id = v.doc_id AND b.start = v.start AND b."end" = v."end" AND (b.same OR NOT b.any_same) AND ((b.ol = v.label AND b.os = v.signal) OR b.ol = 'MISC')) THEN weight * 1.1::DOUBLE ELSE weight END, 6) AS weight
FROM {SUMMED_SQL} v""")
def boosted_votes(spark, sf_dir):
    n = F.col("l_linenumber")
    label = F.when(n % 4 == 0, "MISC").otherwise(F.get(F.lit(["PERSON", "LOC", "DATE"]), (n % 3).cast("int")))
    other = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_OTHER).alias("ent"), label.alias("label"), F.col("l_returnflag").alias("signal"))
    return votes.boost_matches(votes.add_votes(_line_votes(spark, sf_dir)), other, _links(spark, sf_dir))


@query(f"""
SELECT doc_id, ent, start, "end", label, signal, round(CASE WHEN EXISTS (SELECT 1 FROM {LINKS_SQL} l WHERE l.doc_id = v.doc_id AND l.start = v.start AND l."end" = v."end" AND lower(other_ent) IN ({', '.join(map(_quote, sorted(tables.stopwords()['en'])))})) THEN weight * 0.5::DOUBLE ELSE weight END, 6) AS weight FROM {SUMMED_SQL} v""")
def weakened_votes(spark, sf_dir):
    stop = tables.frame(spark, "stopwords").where("lang = 'en'").select("word")
    return votes.weaken_stopwords(votes.add_votes(_line_votes(spark, sf_dir)), _links(spark, sf_dir), stop)


@query(f"""
WITH v AS (SELECT doc_id, ent, start, CAST("end" AS INTEGER) AS "end", label, signal, round(sum(weight), 6) AS weight FROM ({VOTES_SQL}) GROUP BY ALL),
links AS (SELECT DISTINCT doc_id, start, "end", string_split(ent, '@')[1] AS other_ent FROM v WHERE label = 'EMAIL'),
pieces AS (SELECT l.*, string_split(text, other_ent) AS p FROM links l JOIN documents USING (doc_id) WHERE other_ent <> ''),
places AS (SELECT *, unnest(range(1, len(p))) AS k FROM pieces),
copied AS (SELECT pl.doc_id, other_ent AS ent, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(other_ent) AS INTEGER) AS start, v.label, v.signal, v.weight FROM places pl JOIN v ON v.doc_id = pl.doc_id AND v.start = pl.start AND v."end" = pl."end")
SELECT doc_id, ent, start, CAST("end" AS INTEGER) AS "end", label, signal, round(sum(weight), 5) AS weight FROM (
  SELECT doc_id, ent, start, "end", label, signal, weight FROM v UNION ALL SELECT doc_id, ent, start, start + length(ent), label, signal, weight FROM copied) GROUP BY ALL""")
def copied_votes(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    found = votes.add_votes(detect.with_patterns(docs))
    links = found.where("label = 'EMAIL'").select("doc_id", "start", "end", F.split_part("ent", F.lit("@"), F.lit(1)).alias("other_ent")).distinct()
    return votes.copy_labels(found, docs, found, links).withColumn("weight", F.round("weight", 5))


@query(f"""SELECT p_partkey, {_replaces("trim(" + _replaces("m", align._ROUNDS) + ")", ())} AS repaired FROM (SELECT p_partkey, ['[[', '【', '［', 'x['][p_partkey % 4 + 1] || p_name || ['］', ']]', '】 ', ']y'][p_size % 4 + 1] || ' 3 [' || p_brand || ']' AS m FROM part)""")
def repaired_brackets(spark, sf_dir):
    side = lambda marks, c: F.get(F.lit(list(marks)), (F.col(c) % 4).cast("int"))
    marked = F.concat(side(("[[", "【", "［", "x["), "p_partkey"), "p_name", side(("］", "]]", "】 ", "]y"), "p_size"), F.lit(" 3 ["), "p_brand", F.lit("]"))
    return _read(spark, sf_dir, "part").select("p_partkey", align.repair_brackets(marked).alias("repaired"))


_CARD = "CASE o_orderkey % 3 WHEN 0 THEN 'follow @clerk_' || o_custkey || ', profile' WHEN 1 THEN 'number plate AB-' || lpad((o_custkey % 9999)::VARCHAR, 4, '0') || ' seen' ELSE 'mail @nobody or AB-1234 far from it' END"
CARDS_SQL = f"(SELECT o_orderkey AS doc_id, {_CARD} AS text FROM orders)"


@query(f"SELECT doc_id, ent, start, label FROM {_mentions_sql(CARDS_SQL, rules=detect.CONTEXT_RULES)}")
def context_rules(spark, sf_dir):
    card = _CARD.replace("(o_custkey % 9999)::VARCHAR", "CAST(o_custkey % 9999 AS STRING)")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(card).alias("text"))
    return detect.with_patterns(rows, detect.CONTEXT_RULES).select("doc_id", "ent", "start", "label")


@query(f"""SELECT src, tgt, coalesce(model, CASE {' '.join(f"WHEN src = '{a}' AND tgt = '{b}' THEN '{align.MANY_TO_MANY}-{m}-mt'" for (a, b), m in align.TUNED.items())} ELSE '{align.MANY_TO_MANY}' END) AS model
FROM (SELECT a.lang AS src, b.lang AS tgt FROM {_values(sorted((x,) for x in tables.stopwords()), 'lang')} JOIN {_values(sorted((x,) for x in tables.stopwords()), 'lang').replace(' AS t(', ' AS u(')} ON t.lang <> u.lang
) LEFT JOIN {_values(sorted((r['src'], r['tgt'], r['model']) for r in tables.table('translation_models').to_pylist()), 'src, tgt, model')} USING (src, tgt)""".replace("SELECT a.lang AS src, b.lang AS tgt", "SELECT t.lang AS src, u.lang AS tgt"))
def model_of_every_pair(spark, sf_dir):
    langs = sorted(tables.stopwords())
    return align.route(spark.createDataFrame([(a, b) for a in langs for b in langs if a != b], "src string, tgt string")).select("src", "tgt", "model")


# ---- invented values -------------------------------------------------------------------------------


def _number_sql(key: str, salt: str) -> str:
    return f"('0x' || substr(md5('0:{salt}:' || {key}), 1, 8))::BIGINT"


_KEY = "lower(c_name)"
_STATE_SQL = f"CASE WHEN c_custkey % 3 = 0 THEN {_pick_sql(replace._PROVINCES, _KEY, 'state')} ELSE {_pick_sql(replace._STATES, _KEY, 'state')} END"


@query(f"""SELECT c_custkey, {_STATE_SQL} AS state,
  ({_number_sql(_KEY, 'house')} % 200 + 1) || ' ' || {_pick_sql(replace._STREETS, _KEY, 'street')} || ' Street, ' || {_STATE_SQL} AS address,
  lower({_pick_sql(replace._FIRST, _KEY, 'mail')}) || '.' || lower({_pick_sql(replace._LAST, _KEY, 'mail2')}) || ({_number_sql(_KEY, 'mail3')} % 100) || '@example.com' AS email,
  '9' || lpad(({_number_sql(_KEY, 'ssn')} % 100)::VARCHAR, 2, '0') || '-' || lpad((({_number_sql(_KEY, 'ssn')} // 100) % 100)::VARCHAR, 2, '0') || '-' || lpad((({_number_sql(_KEY, 'ssn')} // 10000) % 10000)::VARCHAR, 4, '0') AS ssn FROM customer""")
def invented_values(spark, sf_dir):
    c, lang = F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "zh").otherwise("en")
    return _read(spark, sf_dir, "customer").select("c_custkey", replace.fake_state(c, lang).alias("state"), replace.fake_address(c, lang).alias("address"), replace.fake_email(c).alias("email"), replace.fake_ssn(c).alias("ssn"))


def _person_sql(langs: tuple[str, ...]) -> str:
    """The same names as ``fake_person`` gives 'Ana ' and the customer's name, by the customer's number and language."""
    ent, head, tail = "'Ana ' || c_name", "'ana'", "lower(string_split(c_name, ' ')[-1])"
    whole = f"lower({ent})"
    woman = f"{_number_sql(head, 'sex')} % 2 = 1"

    def by_sex(men, women, key: str, salt: str) -> str:
        return _pick_sql(men, key, salt) if men == women else f"CASE WHEN {woman} THEN {_pick_sql(women, key, salt)} ELSE {_pick_sql(men, key, salt)} END"

    def one(lang: str) -> str:
        lists = replace.name_lists(lang)
        if lang in replace.WIDE:
            return f"{_pick_sql(lists['last'], f'left({ent}, 1)', 'last')} || {_pick_sql(lists['first_male'], f'substr({ent}, 2, 10)', 'first')}"
        first, last = by_sex(lists["first_male"], lists["first_female"], head, "first"), _pick_sql(lists["last"], tail, "last")
        if lang == "vi":
            middle = [f"CASE WHEN {_number_sql(whole, f'some{k}')} % 2 = 1 THEN {by_sex(lists[f'middle_{k}_male'], lists[f'middle_{k}_female'], whole, f'middle{k}')} END" for k in ("first", "second")]
            return f"concat_ws(' ', {last}, {', '.join(middle)}, {first})"
        return f"{first} || ' ' || {last}"

    return f"SELECT c_custkey, CASE c_custkey % {len(langs)} {' '.join(f'WHEN {k} THEN {one(x)}' for k, x in enumerate(langs))} END AS person FROM customer"


SQL["keyed_fake_persons"] = _person_sql(PERSON_LANGS)


# ---- questions -------------------------------------------------------------------------------------

SENTENCES_SQL = "list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')"


@query(f"""
WITH s AS (SELECT item_id, text, {SENTENCES_SQL} AS s, split_part(text, ' ', 2) AS answer FROM benchmark),
one AS (SELECT item_id, answer, s, unnest(range(1, len(s) + 1)) AS k FROM s WHERE answer <> ''),
hit AS (SELECT *, strpos(lower(s[k]), lower(answer)) AS found FROM one)
SELECT item_id, 'generate question: ' || array_to_string(list_transform(s, lambda x, i: CASE WHEN i = k THEN substr(x, 1, found - 1) || ' <hl> ' || answer || ' <hl> ' || substr(x, found + length(answer)) ELSE x END), ' ') || ' </s>' AS prompt FROM hit WHERE found > 0""")
def highlighted_answers(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    made = prompts.question_prompts(b, b.select("doc_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("answer")))
    return made.select(F.col("doc_id").alias("item_id"), "prompt")


@query("SELECT item_id, 'answer: ' || trim(split_part(text, ' ', 2)) || ' context: ' || text || ' </s>' AS prompt FROM benchmark")
def prepended_answers(spark, sf_dir):
    b = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return prompts.question_prompts(b, b.select("doc_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("answer")), "prepend").select(F.col("doc_id").alias("item_id"), "prompt")
