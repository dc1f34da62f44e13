"""Documents in and out: JSON lines (plain or gzip), Parquet, Python values; ids, shards, batches, limits; votes in JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SCHEMA = "id string, text string, lang string, domain string"
VOTES = "array<struct<ent:string,start:int,end:int,votes:array<struct<label:string,signal:string,weight:double>>>>"
BATCH = 25


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str = SCHEMA, bad: str = "_corrupt_record") -> DataFrame:
    """One document for each line. A line that isn't JSON is kept in ``bad``, never run as code. Files ending in .gz are read as gzip, one task each."""
    return spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def default_path(folder: str, lang: str) -> str:
    """Where the corpus of a language is looked for if no file is named."""
    return f"{folder}/{lang}_data.jsonl.gz"


def read_documents(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A local mirror of a dataset, by its ending or ``kind``: parquet, json, orc or csv."""
    kind = kind or next((k for k in ("parquet", "orc", "csv") if k in path.rsplit("/", 1)[-1]), "json")
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    return reader.format(kind).load(path)


def from_values(spark: SparkSession, values: str | dict | Iterable) -> DataFrame:
    """A text, a document, or several of either."""
    rows = [values] if isinstance(values, str | dict) else list(values)
    rows = [{"text": r} if isinstance(r, str) else r for r in rows]
    return spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in ("id", "text", "lang", "domain")) for r in rows], SCHEMA)


def write_json_lines(docs: DataFrame, path: str, by_language: bool = False) -> None:
    """JSON lines in a folder; ``by_language``: one folder for each language."""
    writer = docs.write.mode("overwrite")
    (writer.partitionBy("lang") if by_language else writer).json(path)


def assign_ids(docs: DataFrame, column: str = "id") -> DataFrame:
    """``docs`` with ``doc_id``: the id where it is a number from 0 on, else a new one above all others.

    New ids are counted inside partitions and offset by the counts of those before: two passes and no global sort.
    """
    spark = docs.sparkSession
    known = F.col(column).try_cast("long")
    rows = docs.withColumn("__known", F.when(known >= 0, known)).withColumn("__part", F.spark_partition_id())
    counts = {r[0]: r[1] for r in rows.where("__known is null").groupBy("__part").count().toLocalIterator()}
    top = rows.agg(F.max("__known")).first()[0]
    start, offsets = (-1 if top is None else top) + 1, []
    for part in sorted(counts):
        offsets.append((part, start))
        start += counts[part]
    table = spark.createDataFrame(offsets or [(-1, 0)], "__part int, __first long")
    # the place within the partition is what monotonically_increasing_id has in its lower 33 bits
    place = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__part", F.col("__known").isNull()).orderBy(F.monotonically_increasing_id())) - 1)
    out = place.join(F.broadcast(table), "__part", "left").withColumn("doc_id", F.coalesce("__known", F.col("__first") + F.col("__n")))  # a row for each partition
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"], "doc_id")


def in_order(docs: DataFrame, column: str = "id") -> DataFrame:
    """By the number that the id is; rows without one come first."""
    return docs.orderBy(F.coalesce(F.col(column).try_cast("long"), F.lit(-1)), column)


def limited(docs: DataFrame, cutoff: int, key: str = "doc_id") -> DataFrame:
    """The first ``cutoff`` documents by key; all of them where it is not positive."""
    return docs.orderBy(key).limit(cutoff) if cutoff > 0 else docs


def ranked(docs: DataFrame, key: str = "doc_id", name: str = "rank") -> DataFrame:
    """``docs`` with their place (from 0) by key, nulls last. Places are counted inside ranges of keys and offset by the counts of those before: no window over all rows in one task."""
    return _placed(docs, key, name)[0]


def _placed(docs: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
    """(``ranked``'s rows, their number).

    The first key of each range is fetched once and written into the plan, so a row's range depends on its key alone. The partitions of a range sort
    are sampled and joined anew in every job: a count of them doesn't hold for the next one.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select(F.col(key).alias("k")).where("k is not null").repartitionByRange(parts, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("k"))
    firsts = sorted(r.k for r in ranges.collect())  # a row for each partition
    below = F.size(F.filter(F.lit(firsts), lambda x: x <= F.col(key))) if firsts else F.lit(0)
    rows = docs.withColumn("__range", F.when(F.col(key).isNull(), len(firsts) + 1).otherwise(below))
    total, offsets = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("__range").count().collect()):
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets or [(-1, 0)], "__range int, __first long")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_last())) - 1
    out = rows.withColumn("__in", inside).join(F.broadcast(table), "__range").withColumn(name, F.col("__first") + F.col("__in"))  # a row for each range
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], name), total


def shard(docs: DataFrame, k: int, n: int, key: str = "doc_id") -> DataFrame:
    """Part ``k`` of ``n`` (from 1) by order of key: equal parts, the last one also has the rest."""
    if not 1 <= k <= n:
        raise ValueError("k must be from 1 to n")
    placed, rows = _placed(docs, key, "__rank")
    size = rows // n
    inside = F.col("__rank") >= (k - 1) * size
    return placed.where(inside if k == n else inside & (F.col("__rank") < k * size)).drop("__rank")


def batches(docs: DataFrame, size: int = BATCH, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``batch``, the number of their batch of ``size`` by order of key."""
    return ranked(docs, key, "__rank").withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank")


# ---- votes in JSON ---------------------------------------------------------------------------------


def pack_votes(votes: DataFrame) -> DataFrame:
    """(doc_id, ner): votes nested by mention, in order."""
    spans = votes.groupBy("doc_id", "ent", "start", "end").agg(F.array_sort(F.collect_list(F.struct("label", "signal", "weight"))).alias("votes"))
    return spans.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "ent", "votes"))), lambda m: F.struct(m["ent"].alias("ent"), m["start"].alias("start"), m["end"].alias("end"), m["votes"].alias("votes"))).alias("ner"))


def to_json_arrays(ner: Column) -> Column:
    """``[[mention, start, end, [[[label, signal], weight], ...]], ...]``; votes without a signal are ``[label, weight]``."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)
    pair = lambda v: F.when(v["signal"].isNull(), quoted(v["label"])).otherwise(F.concat(F.lit("["), quoted(v["label"]), F.lit(","), quoted(v["signal"]), F.lit("]")))
    vote = lambda v: F.concat(F.lit("["), pair(v), F.lit(","), v["weight"].cast("string"), F.lit("]"))
    mention = lambda m: F.concat(F.lit("["), quoted(m["ent"]), F.lit(","), m["start"].cast("string"), F.lit(","), m["end"].cast("string"), F.lit(",["), F.array_join(F.transform(m["votes"], vote), ","), F.lit("]]"))
    return F.concat(F.lit("["), F.array_join(F.transform(ner, mention), ","), F.lit("]"))


def from_json_arrays(c: Column) -> Column:
    """The reverse of ``to_json_arrays``, as VOTES: arrays of mixed kinds are read as arrays of JSON texts, level by level."""
    level = lambda x: F.from_json(x, "array<string>")

    def vote(v: Column) -> Column:
        parts = level(v)
        first = F.get(parts, F.lit(0))
        pair = level(first)
        label = F.when(first.startswith("["), F.get(pair, F.lit(0))).otherwise(first)
        signal = F.when(first.startswith("["), F.get(pair, F.lit(1)))
        return F.struct(label.alias("label"), signal.alias("signal"), F.get(parts, F.lit(1)).cast("double").alias("weight"))

    def mention(m: Column) -> Column:
        parts = level(m)
        return F.struct(F.get(parts, F.lit(0)).alias("ent"), F.get(parts, F.lit(1)).cast("int").alias("start"), F.get(parts, F.lit(2)).cast("int").alias("end"), F.transform(level(F.get(parts, F.lit(3))), vote).alias("votes"))

    return F.transform(level(c), mention)


def unpack_votes(packed: DataFrame, column: str = "ner") -> DataFrame:
    """(doc_id, ent, start, end, label, signal, weight) from ``pack_votes``'s rows."""
    rows = packed.select("doc_id", F.inline(column))
    return rows.select("doc_id", "ent", "start", "end", F.inline("votes"))


def with_defaults(docs: DataFrame, lang: str, domain: str = "") -> DataFrame:
    return tx.with_defaults(docs, lang, domain)
