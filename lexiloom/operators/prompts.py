"""Prompts for generating and answering questions, and a registry of the tasks; the models are functions that are given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

END = " </s>"
SENTENCE = "(?<=[.!?])\\s+"


def sentences(c: Column) -> Column:
    """Sentences of a text, white space made single first."""
    flat = F.trim(F.regexp_replace(c, "(?U)\\s+", " "))
    return F.filter(F.split(flat, SENTENCE), lambda s: s != "")


def answer_prompts(docs: DataFrame, end: str = END) -> DataFrame:
    """(doc_id, sentence_no, prompt): for each sentence the whole text with it highlighted."""
    rows = docs.select("doc_id", sentences(F.col("text")).alias("s")).select("doc_id", "s", F.posexplode_outer("s").alias("sentence_no", "one")).where("one is not null")
    shown = F.transform("s", lambda x, i: F.when(i == F.col("sentence_no"), F.concat(F.lit("<hl> "), x, F.lit(" <hl>"))).otherwise(x))
    return rows.select("doc_id", "sentence_no", F.concat(F.lit("extract answers: "), F.array_join(shown, " "), F.lit(end)).alias("prompt"))


def answers_of(generated: Column) -> Column:
    """Answers from a model's output: parts between separators, what follows the last one dropped."""
    flat = F.trim(F.replace(F.replace(generated, F.lit("<pad>"), F.lit("")), F.lit("  "), F.lit(" ")))
    parts = F.split(flat, "<sep>")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.trim(x))


def question_prompts(docs: DataFrame, answers: DataFrame, form: str = "highlight", end: str = END) -> DataFrame:
    """(doc_id, answer, prompt) for ``answers`` (doc_id, answer): each sentence that holds the answer gives a prompt, or (``prepend``) the whole text one."""
    rows = docs.select("doc_id", "text").join(answers.select("doc_id", F.trim("answer").alias("answer")), "doc_id")
    if form == "prepend":
        return rows.select("doc_id", "answer", F.concat(F.lit("answer: "), "answer", F.lit(" context: "), "text", F.lit(end)).alias("prompt"))
    rows = rows.select("doc_id", "answer", sentences(F.col("text")).alias("s")).select("doc_id", "answer", "s", F.posexplode_outer("s").alias("k", "one")).where("one is not null")
    rows = rows.withColumn("at", F.expr("locate(lower(answer), lower(one))")).where("at > 0 and answer <> ''")
    marked = F.concat(F.expr("substring(one, 1, at - 1)"), F.lit(" <hl> "), "answer", F.lit(" <hl> "), F.expr("substring(one, at + length(answer))"))
    rows = rows.withColumn("marked", marked)
    whole = F.array_join(F.transform("s", lambda x, i: F.when(i == F.col("k"), F.col("marked")).otherwise(x)), " ")
    return rows.select("doc_id", "answer", F.concat(F.lit("generate question: "), whole, F.lit(end)).alias("prompt"))


def qa_prompt(question: Column, context: Column, end: str = END) -> Column:
    return F.concat(F.lit("question: "), question, F.lit("  context: "), context, F.lit(end))


def end_to_end_prompt(context: Column, end: str = END) -> Column:
    return F.concat(F.lit("generate questions: "), F.trim(F.regexp_replace(context, "(?U)\\s+", " ")), F.lit(end))


def generate(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "generated") -> DataFrame:
    """``rows`` with a model's output for each prompt, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: model(b[prompt].tolist())})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def ask(docs: DataFrame, answer_model, question_model, form: str = "highlight") -> DataFrame:
    """(doc_id, answer, question): answers are extracted from each sentence, then a question is made for every answer; duplicates once."""
    got = generate(answer_prompts(docs), answer_model)
    answers = got.select("doc_id", F.explode(answers_of(F.col("generated"))).alias("answer")).where("answer <> ''").distinct()
    return generate(question_prompts(docs, answers, form), question_model).select("doc_id", "answer", F.col("generated").alias("question")).distinct()


def answer(rows: DataFrame, model) -> DataFrame:
    """``rows`` (question, context) with the model's answer."""
    return generate(rows.withColumn("prompt", qa_prompt(F.col("question"), F.col("context"))), model, out="answer").drop("prompt")


def ask_all(docs: DataFrame, model) -> DataFrame:
    """(doc_id, question): all questions of a text from one call, cut at separators."""
    made = generate(docs.select("doc_id", end_to_end_prompt(F.col("text")).alias("prompt")), model)
    return made.select("doc_id", F.explode(answers_of(F.col("generated"))).alias("question"))


TASKS: dict[str, Callable] = {"question-generation": ask, "question-answering": answer, "e2e-question-generation": ask_all}


def task(name: str) -> Callable:
    if name not in TASKS:
        raise KeyError(f"unknown task {name}; there are {sorted(TASKS)}")
    return TASKS[name]
