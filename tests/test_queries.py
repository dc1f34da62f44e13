"""Queries of the rules, readers and streams against DuckDB on the same files; what SQL can't say, against worked examples."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import align, replace
from lexiloom.plans import registry, rules
from lexiloom.sources import documents
from lexiloom.streaming import documents as streams

NAMES = sorted(n for n, f in registry.queries().items() if f.__module__ == rules.__name__) + ["answer_prompts", "dictionary_mentions", "lang_agreement_boost", "lang_argmax", "language_gate", "anonymized_text", "marked_items", "mask_in_scope", "ner_collapse", "overlap_merge", "pf_expand"]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, small, duck, name):
    out = registry.queries()[name](spark, small)
    names = sorted(out.columns)
    found = duck.execute(registry.oracle_sql()[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == names
    got = Counter(tuple(plain(r[c]) for c in names) for r in out.collect())
    want = Counter(tuple(plain(r[have.index(c)]) for c in names) for r in found.fetchall())
    assert got == want


def test_stream_of_a_folder_in_several_batches(spark, tmp_path):
    """What arrives file by file is what a table of all of it gives, each row once, also after a restart."""
    rows = [(i, f"mail a{i}@example.org and more") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = streams.votes(streams.read_folder(spark, f"{tmp_path}/in", df.schema, files=2))
        streams.write_json(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        got = spark.read.json(f"{tmp_path}/out")
        assert sorted(r.ent for r in got.collect()) == sorted(f"a{i}@example.org" for i in range(40))


def test_sliding_windows_and_late_events(spark, tmp_path):
    at = lambda s: f"2024-01-01 {s}"
    events = [(at("00:10:00"), "a", 1.0), (at("00:50:00"), "a", 2.0), (at("09:00:00"), "b", 5.0)]
    df = spark.createDataFrame(events, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(f"{tmp_path}/in")
    stream = streams.counts(streams.read_folder(spark, f"{tmp_path}/in", df.schema), slide="30 minutes")
    streams.write_json(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(str(r.window_start)[11:16], r.n, r.total) for r in spark.read.schema(stream.schema).json(f"{tmp_path}/out").collect()}
    assert got == {("23:30", 1, 1.0), ("00:00", 2, 3.0), ("00:30", 1, 2.0)}  # the last event's windows are still open


def test_translator_that_fails(spark):
    def translator(texts, source, target):
        if any("bad" in t for t in texts):
            raise RuntimeError("no translation")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "one"), (2, "bad"), (3, None), (4, "four")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.translated for r in align.translate(rows, translator, "de", "en").collect()}
    assert got == {1: "ONE", 2: " . . . ", 3: None, 4: "FOUR"}


def test_bracket_links(spark):
    df = spark.createDataFrame([("He met 0 [ Anna ] in 1 [ Rome ].", 2, "en"), ("x 7 [ y ] z", 2, "en"), (None, None, None)], "t string, n int, lang string")
    got = [r.b for r in df.select(align.bracket_links("t", "n", "lang").alias("b")).collect()]
    assert [[(x.ent, x.item) for x in b.links] for b in got] == [[("Anna", 0), ("Rome", 1)], [], []]
    assert got[0].text == "He met Anna in Rome ." and got[2].text == ""


def test_names_that_take_many_trials(spark):
    """A known name is never given while one of a thousand seeds gives another."""
    names = spark.createDataFrame([("Ana Gil", "en"), ("Li", "zh")], "ent string, lang string")
    tries = names.select("ent", "lang", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k")).select("ent", replace.fake_person(F.col("ent"), F.col("lang"), None, F.col("k")).alias("name"))
    known = tries.where("ent = 'Ana Gil'").select("name")
    got = {r.ent: r.new for r in replace.without_known(names, known).collect()}
    taken = {r.name for r in known.collect()}
    assert got["Ana Gil"] not in taken and set(got) == {"Ana Gil", "Li"}
    assert {r.new for r in replace.without_known(names.where("lang = 'en'"), known, most=16).collect()} <= taken


@pytest.fixture
def many_parts(spark):
    """Shuffles whose partitions aren't joined: what a sort samples shows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_of_more_rows_than_a_sort_samples(spark, many_parts):
    rows = spark.range(30_000).select((F.col("id") * 7919 % 30_000).alias("doc_id")).repartition(6)
    assert {r.doc_id: r.batch for r in documents.batches(rows).collect()} == {k: k // 25 for k in range(30_000)}
    odd = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "doc_id string")
    assert sorted((r.rank, r.doc_id) for r in documents.ranked(odd).collect()) == [(0, "a"), (1, "b"), (2, "b"), (3, None)]
    assert documents.batches(rows.where("doc_id < 0")).count() == 0


def test_shards_of_more_rows_than_a_sort_samples(spark, many_parts):
    rows = spark.range(30_002).select((F.col("id") * 7919 % 30_002).alias("doc_id")).repartition(6)
    got = [documents.shard(rows, k, 4).agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first() for k in (1, 2, 3, 4)]
    assert [tuple(r) for r in got] == [(0, 7499, 7500), (7500, 14999, 7500), (15000, 22499, 7500), (22500, 30001, 7502)]
