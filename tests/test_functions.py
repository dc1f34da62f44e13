import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import language, tables
from lexiloom.functions import text as tx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_normalisation(spark):
    assert one(spark, tx.normalize(F.col("t")), t="[a]  John's ‘x’s 《b》。") == "(a) John 's ‘x 's 《b》 。"
    assert one(spark, tx.fold_quotes(F.col("t")), t="a。b،c、`d“e”《f»") == "a.b,c,'d\"e\"\"f\""
    assert one(spark, tx.mask_digits(F.col("t")), t="a1970-05") == "a1111-11"
    assert one(spark, tx.strip_emoji(F.col("t")), t="a😀b🇩🇪c") == "abc"
    assert one(spark, tx.normalize(F.col("t")), t=None) is None


@pytest.mark.parametrize("text,want", [("日本語です", "zh"), ("ひらがな", "ja"), ("한국어", "ko"), ("ภาษาไทย", "th"), ("plain", None), ("", None)])
def test_script(spark, text, want):
    assert one(spark, tx.script(F.col("t")), t=text) == want


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("t"), F.col("lang")), t=" a b　c\td ", lang="en") == ["a", "b", "c", "d"]
    assert one(spark, tx.tokens(F.col("t"), F.col("lang")), t="ab😀", lang="zh") == ["a", "b", "😀"]
    assert one(spark, tx.tokens(F.col("t"), F.col("lang")), t="", lang="en") == []


def test_glued_sentences(spark):
    got = one(spark, tx.split_glued(tx.words(F.col("t"))), t="end.Next 3.14 one,Two U.S. www.site.com a!B x")
    assert got == ["end.", "Next", "3.14", "one,", "Two", "U.S.", "www.site.com", "a!", "B", "x"]


def plain_chunks(tokens, size, marks, cjk):
    sep, out, offset = "" if cjk else " ", [], 0
    while len(tokens) > size:
        for j in range(size - 1, len(tokens)):
            if j > 2 * size or (tokens[j] in marks + " " if cjk else tokens[j][-1] in marks):
                break
        part, tokens = tokens[: j + 1], tokens[j + 1 :]
        out.append((sep.join(part), offset, len(part)))
        offset += len(sep.join(part)) + len(sep)
    return out + [(sep.join(tokens), offset, len(tokens))] if tokens else out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "c.", "d,", "é", "😀"]), max_size=40), min_size=1, max_size=8), st.integers(1, 7))
def test_chunks_against_a_loop(spark, texts, size):
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)] + [(100 + i, "".join(t).replace("😀", "。"), "zh") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {}
    for r in sorted(tx.chunks(docs, size).collect(), key=lambda r: (r.doc_id, r.chunk_no)):
        got.setdefault(r.doc_id, []).append((r.chunk_text, r.char_offset, r.n_units))
    for d, t, lang in rows:
        assert got.get(d, []) == plain_chunks(list(t) if lang == "zh" else t.split(), size, tx.MARKS, lang == "zh")
    back = {r.doc_id: r.text for r in tx.join_chunks(tx.chunks(docs, size)).collect()}
    assert back == {d: t for d, t, _ in rows if t}


def test_chunks_of_missing_text(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "a b", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.chunk_text for r in tx.chunks(docs).collect()} == {1: ". . .", 2: "a b"}


def test_subwords(spark):
    row = spark.createDataFrame([(["▁un", "believ", "able", "▁day", "日", "本", "a"],)], "p array<string>")
    assert row.select(tx.merge_subwords(F.col("p")).alias("x")).first().x == ["unbelievable", "day", "日", "本", "a"]


def test_stopword_score(spark):
    rows = [(1, "en", "The house and the garden"), (2, "en", ""), (3, "xx", "what"), (4, "zh", "的的好"), (5, "en", None), (6, "de", "Der Hund und die Katze")]
    got = {r.doc_id: r.score for r in language.stopword_score(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert got[1] == pytest.approx(3 / 5) and got[2] is None and got[3] == 1 and got[5] is None and got[6] == pytest.approx(3 / 5)
    assert got[4] > 0


def test_language_of_texts(spark):
    rows = [(1, "the cat is in the house"), (2, "der hund und die katze"), (3, "zzz qqq"), (4, None), (5, ""), (1, "the cat is in the house")]
    got = sorted(map(tuple, language.best_language(spark.createDataFrame(rows, "doc_id long, text string"), ("de", "en")).collect()))
    assert [r[:2] for r in got] == [(1, "en"), (1, "en"), (2, "de"), (3, None), (4, None), (5, None)]  # every row, and repeated rows don't add up
    assert got[0][2] == got[1][2] == pytest.approx(4 / 6) and got[2][2] == pytest.approx(3 / 5) and {r[2] for r in got[3:]} == {0.0}
    assert {r.best_lang for r in language.best_language(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()} == {"en", "de"}


@pytest.mark.parametrize("first,score,second,want", [("id", 0.8, "ms", 1.2), ("id", 0.8, "id", 0.8), ("id", 0.5, "id", 0.75), ("en", 0.5, "de", 0.5), ("en", 0.5, "en", 0.75), ("la", 0.9, "fr", 1.35)])
def test_agreement(spark, first, score, second, want):
    assert one(spark, language.agreed_score(F.col("a"), F.col("s"), F.col("b")), a=first, s=score, b=second) == pytest.approx(want)


def test_gates(spark):
    assert one(spark, language.gate(F.col("t"), F.col("l"), F.lit("en")), t="x", l="de") == tx.MISSING
    assert one(spark, language.gate(F.col("t"), F.col("l"), F.lit("en")), t="x", l=None) == "x"
    assert [one(spark, language.similar_enough(F.col("s"), u), s=0.72) for u in ("translate", "augment", "back")] == [False, True, True]


def test_persons_are_kept(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id long, text string")
    found = spark.createDataFrame([(i, "x", 0, 1, "PERSON" if i % 2 else "LOC") for i in range(300)], "doc_id long, ent string, start int, end int, label string")
    out = {r.doc_id for r in language.keep_persons(docs, found, 3).collect()}
    assert {i for i in range(400) if i % 2 or i >= 300} <= out and 160 < 400 - len(out) + 60 < 400
    assert language.keep_persons(docs, found.where("label = 'PERSON'"), 3).count() == 400


def test_tables(spark):
    assert len(tables.stopwords()) == 62 and sum(map(len, tables.stopwords().values())) == 22_614
    assert tables.ancestors("PHONE") == ("PHONE", "ID") and tables.ancestors("KEY") == () and tables.COARSE["GPE"] == "LOC" and len(tables.COARSE) == 16 and len(tables.LABELS) == 31
    assert tables.language_group("fr") == {"fr", "la", "br"} and tables.language_group("en") == {"en"} and tables.language_group("ms") == {"id", "ms"}
    assert tables.locales("ca") == ("es_CA", "es_ES", "es_MX") and tables.locales("yo") == ("en_GB",) and tables.locales("bn") == ("hi_IN",)
    assert {r.lang: r.max_len for r in language.longest_stopword(spark).collect()}["zh"] == 6
    assert not any(" " in w for ws in tables.stopwords().values() for w in ws)


def test_language_scores_hold_one_text_at_a_time():
    texts = pa.array(["the and of " + "x" * 20_000] * 400)
    tracemalloc.start()
    best = language.best_scores(pa.array(["de en"] * 400), texts)
    own = language.own_scores(pa.array(["en"] * 400), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {x["best_lang"] for x in best.to_pylist()} == {"en"} and set(own.to_pylist()) == {0.75}
    assert peak < 4_000_000  # the texts have eight million
