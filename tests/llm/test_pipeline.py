"""The pipeline: its contract, and every stage against a plain version on the stage's own input."""

import pathlib
from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline
from lexiloom.llm import mix, quality, shard

from . import brute


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, held = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held.append(docs.collect())
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[: len(names)] == names and (k == 4 or docs.columns == names)
    held.append(docs.collect())
    ids = [Counter(r.doc_id for r in rows) for rows in held]
    text = {r.doc_id: r.text for r in held[0]}
    # 1: decided by the fitted model's tables
    model = quality.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    keep = quality.scores([r.text for r in held[0]], model)[2]
    assert ids[1] == Counter(r.doc_id for r, k in zip(held[0], keep) if k)
    # 2: the smallest of each group
    owner = brute.components(brute.similar([(r.doc_id, r.text) for r in held[1]]))
    assert ids[2] == Counter(d for d in ids[1] if owner.get(d, d) == d)
    # 3: no passage of the benchmark
    items = [(b["item_id"], b["text"]) for b in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    assert ids[3] == Counter(d for d in ids[2] if not brute.leaks(text[d], items))
    # 4: the same documents; 5: each with its shard
    assert ids[4] == ids[3] == ids[5]
    assert Counter((r.doc_id, r.shard) for r in held[5]) == Counter(brute.shards([r.doc_id for r in held[4]], shard.SHARDS, shard.VNODES, shard.SLACK))


def test_training_order_reaches_the_shards(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    corpus_pipeline.ordered_documents(spark, docs, small).write.parquet(f"{tmp_path}/ordered")
    out = corpus_pipeline.sharded_documents(spark, spark.read.parquet(f"{tmp_path}/ordered"), small)
    assert out.columns == [*docs.columns, "position", "shard"]
    got = {r.doc_id: r.position for r in out.collect()}
    assert got == {r.doc_id: r.position for r in mix.mix(docs, budget=None).collect()} and len(set(got.values())) > 0.9 * len(got)


def test_the_mixing_stage_decides_the_order(spark, small, tmp_path):
    """What the fourth stage plans is what the fifth does, also with schedules that the fifth doesn't know; without the stage there is no order."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = sorted(r.source for r in docs.select("source").distinct().collect() if r.source is not None)[0]
    how = {"schedules": {some: [(0.0, 0.0), (0.5, 0.0), (0.6, 50.0), (1.0, 50.0)]}}
    corpus_pipeline.ordered_documents(spark, docs, small, **how).write.parquet(f"{tmp_path}/other")
    out = corpus_pipeline.sharded_documents(spark, spark.read.parquet(f"{tmp_path}/other"), small).collect()
    assert {r.doc_id: r.position for r in out} == {r.doc_id: r.position for r in mix.mix(docs, budget=None, **how).collect()}
    assert min(r.position for r in out if r.source == some) > 0.4
    without = corpus_pipeline.sharded_documents(spark, docs, small).collect()
    assert {r.position for r in without} == {None} and {(r.doc_id, r.shard) for r in without} == {(r.doc_id, r.shard) for r in out}


def through(spark, docs, sf_dir, folder):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def test_awkward_rows_go_through(spark, small, tmp_path):
    """Nulls, empty texts, repeated rows, columns named like those that are added, and a table without rows."""
    some = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (7_000_001, None, "fr", "s", None), (7_000_002, "", None, "s", 0)], some.schema)
    docs = some.unionByName(odd).unionByName(some.limit(10)).selectExpr("*", "'x' AS shard", "'y' AS position", "'z' AS epoch", "doc_id AS owner", "'k' AS `a b`")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = through(spark, docs, small, tmp_path / "rows")
    assert out.columns == [*[c for c in docs.columns if c not in ("shard", "position", "epoch")], "position", "shard"]
    got = Counter((r.doc_id, r.text) for r in out.collect())
    every = Counter((r.doc_id, r.text) for r in docs.collect())
    assert got and all(got[k] == every[k] for k in got)  # repeated rows stay or go together
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    if quality.scores([""], model)[2][0]:
        assert {(None, None), (None, ""), (7_000_001, None)} <= set(got)
    assert through(spark, docs.where("1 = 0"), small, tmp_path / "none").count() == 0


def test_run_gives_the_stages_rows(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns[-1] == "shard" and out.count() > 0
    assert {r.shard for r in out.select("shard").distinct().collect()} <= set(range(shard.SHARDS))
    folder = spark.conf.get("spark.checkpoint.dir")
    tables = [p.name for p in pathlib.Path(folder).glob("*/pipeline-*/*")]
    assert tables == ["3-source_mixing"]
