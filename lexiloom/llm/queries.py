"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact, jaccard, langid, mix, ngramlm, quality, shard, tokens, urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.to_binary(_read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.train(pages))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(_read(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "conversations"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copies(_read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


JACCARD_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
entries AS MATERIALIZED (SELECT row_number() OVER () AS e, doc_id, s FROM sets WHERE len(s) > 0),
grams AS (SELECT e, len(s) AS n, unnest(s) AS g FROM entries),
pairs AS MATERIALIZED (
  SELECT a.e AS x, b.e AS y FROM grams a JOIN grams b ON a.g = b.g AND a.e < b.e AND a.n <= 2 * b.n AND b.n <= 2 * a.n
  GROUP BY a.e, b.e, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)),
ends AS MATERIALIZED (
  SELECT p.doc_id AS d, q.doc_id AS o FROM (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs) t JOIN entries p ON p.e = t.x JOIN entries q ON q.e = t.y),
links AS (SELECT d AS doc_id, count(*) AS links FROM ends GROUP BY d),
reach AS (SELECT DISTINCT d, d AS o FROM ends UNION SELECT r.d, e.o FROM reach r JOIN ends e ON r.o = e.d)
SELECT doc_id, min(o) AS class_id, any_value(links) AS links FROM links JOIN reach ON doc_id = d GROUP BY doc_id
"""


COPIES_SQL = """
SELECT DISTINCT doc_id, owner_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE doc_id <> owner_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": COPIES_SQL, "op5_ngram_jaccard_join": JACCARD_SQL}
