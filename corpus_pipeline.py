"""From raw documents to shards for training, in five stages, each written as Parquet and read again as the next one's input.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``.

Defined results
* null or empty text: judged by the classifier like any text; what it keeps has no n-grams and no passage, so it stays, and counts as one token.
* null doc_id: such rows are each by themselves in the Jaccard join, and have the key '' in mixing and sharding. Repeated rows of a doc_id are one document:
  they stay or go together. Of a class of similar documents the smallest doc_id stays.
* an empty table, or labels or benchmark without rows: no rows, or nothing rejected by that stage. Extra columns pass through all stages; only ``position`` and
  ``shard`` are replaced by those of the last one, and ``epoch`` is dropped there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontam, jaccard, mix, quality, shard
from lexiloom.llm.common import checkpoint_root, remove


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (poor or toxic) go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (n-gram Jaccard), that with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat passages of the benchmark go."""
    return decontam.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The key in the metadata of doc_id under which a table of ordered documents names the plan of its order.
ORDER = "training_order"


def ordered_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, **how) -> DataFrame:
    """Documents in training order: every one is placed once, where its source's weight schedule asks for it. The stage only orders: no document is cut or repeated.

    A written table keeps no order of rows, and the stage's columns are those of ``documents``. So the order goes on as its plan: a row for each source in the shared folder,
    which the metadata of doc_id names; they are written with the table. ``how``: other schedules or powers than the default.
    """
    from uuid import uuid4

    at = f"{checkpoint_root(spark)}/mixing-{uuid4().hex}"
    lookup, rest = mix.plan(docs, budget=None, **how)
    lookup.write.parquet(at)
    out = mix.place(docs, spark.read.parquet(at), **rest)
    held = docs.schema["doc_id"].metadata | {ORDER: json.dumps({"at": at} | rest)}
    return out.select(*[F.col(f"`{c}`").alias(c, metadata=held) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their position in training order and the shard that the ring gives them, no shard above its bound.

    Positions follow the plan of the stage before; documents that come without one are in no order, and their position is null.
    """
    told = docs.schema["doc_id"].metadata.get(ORDER)
    if told is None:
        placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in mix.ADDED], F.lit(None).cast("double").alias("position"))
    else:
        rest = json.loads(told)
        placed = mix.place(docs, spark.read.parquet(rest.pop("at")), **rest, sort=False).drop("epoch")
    return shard.assign(placed)


STAGES = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", clean_documents),
    ("source_mixing", ordered_documents),
    ("sharding", sharded_documents),
]

#: The classifier is fitted and the order of insertion is sequential: no SQL gives these rows. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of ``sf_dir``, with a written table between them in the shared checkpoint folder.

    A table goes once the next one is written; the last stage's input and the plan of its order stay, as the result is read from them.
    """
    from uuid import uuid4

    folder = f"{checkpoint_root(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
