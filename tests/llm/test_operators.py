"""Each operator against a plain version, over awkward rows and a small table."""

import bisect
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontam, exact, jaccard, kernel, langid, mix, ngramlm, quality, queries, shard, tokens, urls

from . import brute

EXTRA = ("shard", "epoch", "position", "owner", "sid", "a", "row", "words", "__h", "__rank", "owner_id", "keep")
PASSAGE = "one passage of the test that must never be found in any training text at all"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old farm house."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the old farm barn."),
    (3, "The quick brown fox jumps over the lazy dog and runs away from the old farm house."),
    (3, "The quick brown fox jumps over the lazy dog and runs away from the old farm house."),
    (4, ""),
    (5, ""),
    (6, None),
    (None, "The quick brown fox jumps over the lazy dog and runs away from the old farm house."),
    (None, None),
    (7, "😀 emoji und Ünïcödé: " + PASSAGE.upper() + ", no less!"),
    (8, "word " * 60_000),
    (9, " \n\t … !!!"),
    (10, "single"),
    (11, "single"),
    (12, "two words"),
    (8, "a second text of the same document"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(d, t, ["en", None, "fr"][i % 3], [None, "s1", "s2"][i % 3], None if t is None else len(t), *[f"x{i}"] * len(EXTRA)) for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(small):
    return pq.read_table(f"{small}/documents.parquet").to_pylist()


def none(df):
    return df.where("1 = 0")


# ---- 1 ----


def test_decontamination(spark, awkward, docs, rows, small):
    items = [(1, PASSAGE), (2, "too short"), (3, "over the lazy dog"), (3, "over the lazy dog"), (None, PASSAGE), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_leaks(awkward, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, t in TEXTS for i in brute.leaks(t, [x for x in items if x[0] is not None])}
    for r in got:
        texts = [t[r.start_char : r.end_char] for d, t in TEXTS if d == r.doc_id and t]
        assert any(brute.words(x) in (brute.words(PASSAGE), brute.words("over the lazy dog")) and len(brute.words(x)) == r.n_words for x in texts)
    kept = decontam.drop_leaked(awkward, bench)
    assert kept.columns == awkward.columns
    assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == Counter((d, t) for d, t in TEXTS if not brute.leaks(t, [x for x in items if x[0] is not None]))
    table = pq.read_table(f"{small}/benchmark.parquet").to_pylist()
    found = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, small).collect()}
    assert found == {(r["doc_id"], i) for r in rows for i in brute.leaks(r["text"], [(b["item_id"], b["text"]) for b in table])}
    assert decontam.find_leaks(awkward, none(bench)).count() == 0 == decontam.find_leaks(none(awkward), bench).count()
    assert decontam.drop_leaked(awkward, none(bench)).count() == len(TEXTS)


def test_decontamination_spans_of_any_windows(spark):
    """Every run that lies over an item in ``window`` words or more, none shorter, with offsets of the original text."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(40)]
    docs = [(i, text(20) + " " + ", ".join(items[rng.randrange(40)][1].upper().split()[rng.randint(0, 3) :]) + " " + text(rng.randint(0, 9))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 5, 8):
        want = set()
        for d, t in docs:
            w = brute.words(t)
            for i, x in items:
                v = brute.words(x)
                if len(v) < 4:
                    continue
                for shift in range(-len(v), len(w) + 1):
                    same = [0 <= j - shift < len(v) and v[j - shift] == w[j] for j in range(len(w))] + [False]
                    first = 0
                    for j, ok in enumerate(same):
                        if not ok:
                            if j - first >= min(window, len(v)):
                                want.add((d, i, first, j - first))
                            first = j + 1
        at = {d: [k for k in range(len(t)) if t[k].isalnum()] for d, t in docs}  # words of one letter
        got = [(r.doc_id, r.item_id, at[r.doc_id].index(r.start_char), r.n_words) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, window=window).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_decontamination_with_a_large_benchmark(spark, awkward):
    """Half a million words of test items are still one automaton and one scan."""
    items = [(i, " ".join(f"w{i * 100 + k}" for k in range(100))) for i in range(5_000)] + [(9_999, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(items[17][1].split()[40:49]) + " y"), (2, items[17][1][:30]), (7, PASSAGE)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_words) for r in decontam.find_leaks(docs, bench).collect()} == {(1, 17, 9), (7, 9_999, len(PASSAGE.split()))}
    assert decontam.drop_leaked(awkward, bench).where("doc_id = 7").isEmpty()


# ---- 2 ----


def test_language_id(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"), sample=300)
    test = docs.where("doc_id % 2 = 1")
    got = langid.identify(test, model).join(test.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang").count() >= 0.97 * got.count()
    assert {(r.family, r.language) for r in got.select("family", "language").distinct().collect()} <= {("romance", "fr"), ("romance", "es"), ("germanic", "en"), ("germanic", "de"), (None, None)}
    out = langid.identify(awkward, model)
    assert out.columns == ["doc_id", "family", "language", "margin"] and out.count() == len(TEXTS)
    assert out.where("doc_id in (4, 5, 6, 9) and language is null and margin = 0").count() == 4
    assert langid.identify(none(awkward), model).count() == 0
    assert langid.identify(awkward, langid.train(none(docs))).where("language is not null").count() == 0
    one = langid.identify(awkward, langid.train(docs.where("lang = 'fr'"), sample=20))
    assert {r.language for r in one.collect()} == {"fr", None}


def test_language_id_against_a_plain_vote(spark):
    """Features, families, votes and margins recomputed text by text."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame([(d, t, x) for i, (d, t, x) in enumerate(rows)] + [(5_000, "", "en"), (5_001, "x", "fr")], "doc_id long, text string, lang string")
    model = langid.train(docs, sample=120)
    assert set(model["pairs"]) == {("de", "en"), ("es", "fr")} and set(model["first"]) == {"germanic", "romance"}
    for r, (_, text, _) in zip(sorted(langid.identify(docs, model).where("doc_id < 5000").collect(), key=lambda r: r.doc_id), sorted(rows)):
        assert (r.family, r.language) == pytest.approx(brute.language(text, model)[:2])
        assert r.margin == pytest.approx(brute.language(text, model)[2], abs=1e-4)
    X = np.random.default_rng(1).normal(size=(200, 5)).astype(np.float32)
    w = langid.svm(X, np.where(X[:, 0] + 0.5 * X[:, 1] > 0.1, 1.0, -1.0))
    assert (np.sign(X @ w[:5] + w[5]) == np.sign(X[:, 0] + 0.5 * X[:, 1] - 0.1)).mean() > 0.97


def test_language_id_of_many_short_texts_in_bounded_memory(spark):
    import tracemalloc

    import pyarrow as pa

    model = langid.fit(langid.features(["the old house and", "das alte Haus und", "la vieille maison et"]), ["en", "de", "fr"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array(["", "ein Wort"] * 10_000)], ["doc_id", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in langid.label_rows(iter([batch]), type("Shared", (), {"value": model})))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 300e6


# ---- 3 ----


def test_token_blocks(spark, awkward):
    made = tokens.to_binary(awkward).cache()
    assert Counter((r.doc_id, r.text) for r in tokens.to_text(made).collect()) == Counter(TEXTS)
    for r in made.collect():
        if r.payload is None:
            assert r.n_tokens is None and r.block_starts is None
        else:
            whole = tokens.unpack(bytes(r.payload))
            assert len(whole) == r.n_tokens and len(r.block_starts) == -(-r.n_tokens // tokens.BLOCK)
            for k in range(len(r.block_starts)):
                assert np.array_equal(tokens.unpack_block(bytes(r.payload), k)[: len(whole[k * 128 : k * 128 + 128])], whole[k * 128 : k * 128 + 128])
    assert tokens.to_binary(none(awkward)).count() == 0
    with pytest.raises(ValueError):
        tokens.to_binary(awkward, block=100)


def test_patched_blocks_of_any_values():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 128, 129, 1000):
        for top in (1, 2, 300, 2**31, 2**32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.05] = 2**32 - 1
            assert np.array_equal(tokens.unpack(tokens.pack(ids)[0]), ids)


def test_blocks_against_a_plain_packer():
    rng = np.random.default_rng(5)
    every = [rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32) for n, top in ((128, 9), (256, 50_000), (0, 5), (384, 2**32), (128, 1))]
    every[1][::37] = 4_000_000_000
    for ids, (payload, starts) in zip(every, tokens.pack_many(every)):
        head = 14 + 4 * len(starts)
        blocks = [brute.packed_block(list(map(int, ids[k : k + 128]))) for k in range(0, len(ids), 128)]
        assert payload[head:] == b"".join(blocks) and payload == tokens.pack(ids)[0]
        assert starts == [sum(map(len, blocks[:k])) for k in range(len(blocks))]


# ---- 4 ----


def test_url_filter(spark):
    rng = random.Random(3)
    good = [f"http://news{rng.randint(1, 90)}.example.org/world/article-{rng.randint(1, 9999)}" for _ in range(300)]
    bad = [f"http://win-{rng.choice(['big', 'cash', 'fast'])}{rng.randint(1, 99)}.example.biz/bonus?id={rng.randint(1, 9999)}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, i < 300) for i, u in enumerate(good + bad)], "page_id long, url string, ok boolean")
    model = urls.train(pages.where("page_id % 2 = 0"), F.col("ok"))
    got = urls.filter_urls(pages.where("page_id % 2 = 1"), model).join(pages, "page_id")
    assert got.where("accepted = ok").count() >= 0.97 * got.count()
    few = urls.fit(*(sorted({urls.normal(u) for u in x[:8]}) for x in (good, bad)))
    g, b = (sorted({urls.normal(u) for u in x[:8]}) for x in (good, bad))
    learn = lambda x: urls.parted(x)[1]
    for u in ("news1.example.org/world", "win-big7.example.biz/bonus", "é"):
        assert urls.score([u], few["models"])[0] == pytest.approx(brute.url_score(u, learn(g), learn(b)), abs=1e-5)
    known = {r.u: r.good for r in spark.createDataFrame([(u,) for u in ("http://m.free-bets.org/a", "https://adsense.org/ads", "x.ads-track.com", "spam", "http://spammer.net", "http://win.casino2.com:80/")], "u string").withColumn("good", urls.seeded(F.col("u"))).collect()}
    assert [u for u, g in known.items() if not g] == ["http://m.free-bets.org/a", "x.ads-track.com", "spam", "http://win.casino2.com:80/"] and known["https://adsense.org/ads"]
    whole = "http://a.example.org/" + "x/" * 400_000
    long = urls.filter_urls(spark.createDataFrame([(1, whole), (2, whole[:-1])], "page_id long, url string"), model).collect()
    assert len(long) == 2 and long[0].url_score == long[1].url_score and abs(long[0].url_score) < 20
    odd = spark.createDataFrame([(1, None, None), (None, "", None), (3, "http://x.org/", "p"), (3, "http://x.org/", "p")], "page_id long, url string, accepted string")
    out = urls.filter_urls(odd, model).collect()
    assert [(r.url_score, r.accepted) for r in out if r.page_id != 3] == [(None, True)] * 2 and len(out) == 4
    assert urls.filter_urls(none(odd), model).count() == 0
    blank = urls.filter_urls(odd, urls.train(none(pages), F.col("ok"))).collect()
    assert all(r.accepted and r.url_score in (None, 0.0) for r in blank)


def test_url_models_are_of_all_urls(spark, monkeypatch):
    """Counts and threshold are those of all URLs at once, also beyond the 20,000 that were once enough, and where a kind has hosts of one part only."""
    rng = random.Random(9)
    good = [f"http://news{rng.randint(1, 40)}.example.org/a-{k}" for k in range(20_000)]
    bad = [f"HTTP://Win{rng.randint(1, 30)}.example.biz/bonus?id={k}" for k in range(3_000)]
    one = ["http://only.example.net/" + str(k) for k in range(60)]
    for kinds in ((good, bad), (good[:300], one), (one, one[:1] + bad[:200])):
        pages = spark.createDataFrame([(u, k == 0) for k, urls_ in enumerate(kinds) for u in urls_], "url string, ok boolean").repartition(5)
        ok = {u: True for u in kinds[0]} | {u: False for u in kinds[1]}
        want = urls.fit([urls.normal(u) for u, k in ok.items() if k], [urls.normal(u) for u, k in ok.items() if not k])
        got = urls.train(pages, F.col("ok"))
        assert got["threshold"] == want["threshold"]
        for mine, theirs in zip(got["models"], want["models"]):
            for x, y in zip(mine, theirs):
                assert all(np.array_equal(a, b) for a, b in zip(x, y))
    monkeypatch.setattr(urls, "COUNTS", 100)
    batches = pa_batches([(urls.normal(u), k == 0, False) for k, some in enumerate((good[:500], bad[:500])) for u in some])
    parts = [np.frombuffer(x, urls.RECORD) for b in urls.counted(iter(batches), 3) for x in b.column(1).to_pylist()]
    assert len(parts) > 3 and urls.merged(parts)["count"].sum() == sum(12 * len(urls.normal(u)) for u in good[:500] + bad[:500])


def pa_batches(rows):
    import pyarrow as pa

    table = pa.table({"url": [r[0] for r in rows], "good": [r[1] for r in rows], "held": [r[2] for r in rows]})
    return table.to_batches(max_chunksize=100)


# ---- 5 ----


def linked(df):
    rows = [tuple(r) for r in jaccard.join(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_jaccard_join(spark, awkward, docs, rows):
    assert linked(awkward) == brute.classes(TEXTS)
    assert linked(docs) == brute.classes([(r["doc_id"], r["text"]) for r in rows])
    assert jaccard.join(none(awkward)).count() == 0


def test_jaccard_join_in_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(40)] for _ in range(6)]
    texts = []
    for i in range(150):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(40)] = "z" + str(rng.randint(0, 99))
        texts.append((i % 140, " ".join(w[: rng.randint(25, 40)])))  # some documents have two texts
    texts += [(200 + i, t) for i, (_, t) in enumerate(texts[:9] * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = brute.classes(texts)
    assert linked(df) == want and sum(x[2] for x in want) > 600
    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "LIST_BYTES", 500)
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 1_000)
    assert linked(df) == want
    owner = {d: c for d, c, _ in want}
    assert {r.doc_id for r in jaccard.one_of_each(df).collect()} == {d for d, _ in texts if owner.get(d, d) == d}


def test_jaccard_join_of_a_table_ingested_twice(spark):
    same = "one two three four five six seven eight nine ten"
    texts = [(1, f"{same} a b c d e f g h i j"), (2, f"{same} k l m n o p q r s t"), (3, f"{same} a b c d e f g h i z"), (4, "alone in the world it is")]
    twice = spark.createDataFrame(spark.sparkContext.parallelize(texts * 2, 2), "doc_id long, text string")  # the same rows in two partitions
    assert linked(twice) == brute.classes(texts) == {(1, 1, 1), (3, 1, 1)}
    assert sorted(r.doc_id for r in jaccard.one_of_each(twice).collect()) == [1, 1, 2, 2, 4, 4]


def test_many_short_texts_in_one_partition(spark):
    df = spark.range(70_000).selectExpr("id AS doc_id", "concat('w', id div 2) AS text").coalesce(1)
    assert linked(df) == {(i + k, i, 1) for i in range(0, 70_000, 2) for k in (0, 1)}
    out = ngramlm.score(df, spark.createDataFrame([("w34999 w34999",)], "text string")).collect()
    assert len(out) == 70_000 and {r.n_words for r in out} == {1}
    high = max(r.log_prob for r in out)
    assert {r.doc_id for r in out if r.log_prob == high} == {69_998, 69_999}


def test_candidate_lists_against_all_pairs():
    """Long lists are skipped by blocks without losing a pair."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = {i: np.unique(rng.choice(60, rng.integers(10, 40), replace=False)).astype(np.uint64) for i in range(200)}
    rows = pa.RecordBatch.from_arrays([pa.array(list(sets)), pa.array([len(s) for s in sets.values()], pa.int32()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["sid", "size", "grams"])
    blocks = pa.Table.from_batches(list(jaccard.postings(iter([rows]), 0.5, 1)))
    found = jaccard.candidates(blocks, 0.5)
    got = set(zip(found.column("a").to_pylist(), found.column("b").to_pylist()))
    want = {(i, j) for i in sets for j in sets if i < j and 3 * len(np.intersect1d(sets[i], sets[j])) >= len(sets[i]) + len(sets[j])}
    assert want <= got and want


def near_copies(number, words=12):
    """The packed lists of so many sets that differ in a n-gram or two, in one bucket; the sets."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sets = []
    for _ in range(number):
        g = np.arange(words, dtype=np.uint64)
        g[rng.integers(0, words, 2)] = rng.integers(100, 10**9, 2).astype(np.uint64)
        sets.append(np.unique(g))
    rows = pa.RecordBatch.from_arrays([pa.array(range(number)), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "size", "grams"])
    return list(jaccard.postings(iter([rows]), 0.5, 1)), sets


def test_candidates_of_many_near_copies_hold_few_pairs(monkeypatch):
    """What a task holds is bounded however many pairs its lists have, and no count is lost or made twice where they are sent in parts."""
    import tracemalloc

    blocks, sets = near_copies(600)
    monkeypatch.setattr(jaccard, "FOLD", 10_000)
    monkeypatch.setattr(jaccard, "PAIRS", 10_000)
    monkeypatch.setattr(jaccard, "PART", 60)  # two parts have about a third of PAIRS, as by default
    tracemalloc.start()
    sent = sum(map(len, jaccard.candidate_batches(iter(blocks), 0.5)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000  # the pairs' own columns alone are 600 * 599 / 2 * 48 bytes, and sorting took as much again
    assert 600 * 599 // 2 <= sent < 2 * 600 * 599 // 2
    got, after = Counter(), {}
    for b in jaccard.candidate_batches(iter(blocks), 0.5):
        for x, y, nx, ny, c, left in zip(*(v.to_pylist() for v in b.columns)):
            assert x < y and (nx, ny) == (len(sets[x]), len(sets[y]))
            got[x, y] += c
            after[x, y] = min(left, after.get((x, y), left))
    monkeypatch.setattr(jaccard, "PART", 1_000)
    monkeypatch.setattr(jaccard, "PAIRS", 10_000_000)
    whole = [r for b in jaccard.candidate_batches(iter(blocks), 0.5) for r in zip(*(v.to_pylist() for v in b.columns))]
    assert len(whole) == len(got) and {(x, y): (c, left) for x, y, _, _, c, left in whole} == {k: (got[k], after[k]) for k in got}


def test_document_lists_are_spread_over_buckets():
    """The bucket that brings a chunk's documents along is not the same one for all chunks."""
    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary())])
    grams = kernel.mix(np.arange(4_000, dtype=np.uint64))
    homes = Counter()
    for part in range(8):
        for number in range(8):
            (b,) = jaccard._chunk([np.arange(40)], [np.full(40, 100)], [grams], 16, part << 24 | number, schema)
            homes.update(x["bucket"] for x in b.to_pylist() if x["docs"])
    assert sum(homes.values()) == 64 and max(homes.values()) <= 12


def test_cells_are_bounded_by_bytes(spark, monkeypatch):
    """Large sets make small cells."""
    held = []
    monkeypatch.setattr(jaccard, "CELL_BYTES", 4_000)
    cut = jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: held.append(df) or cut(df))
    rng = random.Random(8)
    texts = []
    for i in range(60):
        w = [f"w{k}" for k in range(120)]
        w[rng.randrange(120)] = f"z{i}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert linked(df) == brute.classes(texts) == {(i, 0, 59) for i in range(60)}
    cells = next(x for x in held if x.columns == ["sid", "links", "peer"])
    assert cells.groupBy("sid").count().agg(F.max("count")).first()[0] > 5  # a set is in a cell with each other part


def test_groups_of_a_long_chain(spark):
    n = 300
    ids = random.Random(5).sample(range(10 * n), n)  # each text is similar to the next only
    texts = [(d, " ".join(f"w{k}" for k in range(10 * i, 10 * i + 32))) for i, d in enumerate(ids)]
    out = {r.doc_id: r.class_id for r in jaccard.join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == dict.fromkeys(ids, min(ids))


def test_one_of_each_keeps_rows(awkward):
    out = jaccard.one_of_each(awkward)
    assert out.columns == awkward.columns
    owner = brute.components(brute.similar(TEXTS))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d, t) for d, t in TEXTS if d is None or owner.get(d, d) == d)


# ---- 6 ----


def test_sharding(spark, awkward):
    for shards, slack in ((4, 0.05), (16, 0.0), (3, 1.0)):
        df = spark.createDataFrame([(i * 7919 % 100_003,) for i in range(2_000)], "doc_id long")
        got = [(r.doc_id, r.shard) for r in shard.assign(df, shards=shards, slack=slack).collect()]
        assert sorted(got) == sorted(brute.shards([d for d, _ in got], shards, shard.VNODES, slack))
        assert max(Counter(s for _, s in got).values()) <= -(-2_000 * (1 + slack) // shards)
    out = shard.assign(awkward, shards=4)
    assert out.columns == [*[c for c in awkward.columns if c != "shard"], "shard"] and out.count() == len(TEXTS)
    assert Counter((r.doc_id, r.shard) for r in out.collect()) == Counter(brute.shards([d for d, _ in TEXTS], 4, shard.VNODES, shard.SLACK))
    assert shard.assign(none(awkward)).count() == 0


def test_ring_of_more_points_than_two_bytes_count(spark):
    """No point is lost, and the lookup finds each key's arc."""
    points = shard.ring(40, 2_000)
    assert len(points) == 80_000
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("d"))
    places = [p for p, _ in points]
    for r in df.select("d", shard.arc_of(F.col("d"), places).alias("arc")).collect():
        assert r.arc == bisect.bisect_left(places, r.d[:16]) % len(places)
    out = [(r.doc_id, r.shard) for r in shard.assign(spark.range(3_000).withColumnRenamed("id", "doc_id"), shards=300).collect()]
    assert sorted(out) == sorted(brute.shards([d for d, _ in out], 300, shard.VNODES, shard.SLACK))


def test_sharding_moves_little(spark):
    df = spark.createDataFrame([(i,) for i in range(4_000)], "doc_id long")
    a, b = (dict(map(tuple, shard.assign(df, shards=k, slack=0.25).collect())) for k in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


# ---- 7 ----


@pytest.mark.parametrize("first", [1, 2, 8])
def test_language_model(spark, awkward, first):
    corpus = ["the quick brown fox jumps over the lazy dog and runs away from the old barn", "the lazy dog runs", None, "", "a b c d e f g h i j k l m n o p q r s t", "the quick brown fox"]
    asked = [*TEXTS, (20, "x b c d e f g h i j k l m n o p q z"), (21, "the dog the fox the")]
    frame = spark.createDataFrame([(t,) for t in corpus], "text string")
    df = spark.createDataFrame(asked, "doc_id long, text string")
    got = ngramlm.score(df, frame, first=first, wider=2).collect()
    want = [(d, n, lp and round(lp, 6), m if m is None else round(m, 6)) for (d, _), (n, lp, m) in zip(asked, brute.language_model(corpus, [t for _, t in asked]))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=2e-6)


def scored(spark, asked, corpus, **how):
    frame = spark.createDataFrame([(t,) for t in corpus], "text string")
    got = ngramlm.score(spark.createDataFrame(asked, "doc_id long, text string"), frame, **how).collect()
    want = [(d, *x) for (d, _), x in zip(asked, brute.language_model(corpus, [t for _, t in asked]))]
    assert len(got) == len(want)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got)), sorted(want, key=lambda r: (r[0], r[1]))):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=2e-6)


@pytest.mark.parametrize("partitions", ["4", "60"])
def test_language_model_with_hot_words_and_copies(spark, monkeypatch, partitions):
    rng = random.Random(11)
    monkeypatch.setattr(ngramlm, "CHUNK_WORDS", 200)
    monkeypatch.setattr(kernel, "CHUNK_TEXTS", 7)
    if partitions == "60":
        monkeypatch.setattr(ngramlm, "SHARD_WORDS", 100)
    text = lambda: " ".join(rng.choice(["a", "a", "a", "b", "b", "c", "d", "e", "f"]) for _ in range(rng.randint(0, 25)))
    long = " ".join(f"w{i}" for i in range(70))
    corpus = [text() for _ in range(40)] + ["a b a c"] * 15 + [None, "", long]
    asked = [(i, text()) for i in range(40)] + [(100 + i, "a b a c a") for i in range(9)] + [(200, long), (201, "x " + long + " y"), (202, long[9:]), (100, "a b")]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        scored(spark, asked, corpus)
        scored(spark, asked, corpus, first=1, wider=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_language_model_knows_every_word(spark):
    letters = "abcdefghij"
    name = lambda i: "".join(letters[int(c)] for c in f"{i:05d}")
    corpus = [" ".join(name(i) for i in range(a, a + 1_000)) for a in range(0, 70_000, 1_000)]
    frame = spark.createDataFrame([(t,) for t in [*corpus, *corpus[:65]]], "text string")
    n, v = 70_000 + 65_000, 70_000  # the words from 65,000 on are the rarest
    rare = [name(i) for i in (69_001, 69_002, 69_003)]
    df = spark.createDataFrame([(1, " ".join(rare)), (2, "unseen " + rare[1]), (3, f"{rare[0]} unseen"), (4, f"unseen1 unseen2 {rare[2]}")], "doc_id long, text string")
    got = {r.doc_id: (r.log_prob, r.mean_context) for r in ngramlm.score(df, frame).collect()}
    once, never, after = np.log(2 / (n + v + 1)), np.log(1 / (n + v + 1)), np.log((1 + 2 / (n + v + 1)) / 2)
    assert got[1] == pytest.approx(((once + 2 * after) / 3, 1.0), abs=2e-6)
    assert got[2] == pytest.approx(((never + once) / 2, 0.0), abs=2e-6)
    assert got[3] == pytest.approx(((once + np.log(1 / (n + v + 1) / 2)) / 2, 0.5), abs=2e-6)
    assert got[4] == pytest.approx(((2 * never + once) / 3, 0.0), abs=2e-6)


def test_language_model_of_nothing(spark, awkward):
    corpus = spark.createDataFrame([(None,)], "text string")
    out = ngramlm.score(awkward, corpus)
    assert out.count() == len(TEXTS) and {r.log_prob for r in out.collect()} == {None, 0.0}
    assert ngramlm.score(none(awkward), corpus).count() == 0


# ---- 8 ----


def placed(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(g[2] == pytest.approx(w[2], abs=1e-6) for g, w in zip(got, want))


@pytest.mark.parametrize("budget", [None, "all", 5_000])
def test_mixing(spark, awkward, docs, rows, budget):
    """The registered mode is that of all tokens."""
    plain = [(r["doc_id"], r["source"], r["text"]) for r in rows]
    out = mix.mix(docs, budget=budget).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    placed([(r.doc_id, r.epoch, r.position) for r in out], brute.positions(plain, budget=budget))
    odd = [(r.doc_id, r.source, r.text) for r in awkward.collect()]
    out = mix.mix(awkward, budget=budget)
    assert out.columns == [*[c for c in awkward.columns if c not in mix.ADDED], "epoch", "position"]
    placed([(r.doc_id, r.epoch, r.position) for r in out.collect()], brute.positions(odd, budget=budget))
    if budget is None:
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(TEXTS)
    assert mix.mix(none(awkward), budget=budget).count() == 0


def test_mixing_of_very_many_sources(spark, monkeypatch):
    """Histograms are as fine for ten thousand sources as for two, and the table is then joined by source."""
    df = spark.range(12_000).selectExpr("id AS doc_id", "CASE WHEN id < 3000 THEN 'hot' ELSE concat('s', id % 4500) END AS source", "repeat('word ', cast(id % 50 AS int)) AS text")
    plain = [tuple(r) for r in df.select("doc_id", "source", "text").collect()]
    plan = {"hot": [(0, 0.5), (0.5, 0.1), (1, 0.4)]}
    want = brute.positions(plain, budget="all", schedules=plan)
    placed([(r.doc_id, r.epoch, r.position) for r in mix.mix(df, schedules=plan).collect()], want)
    monkeypatch.setattr(mix, "BROADCAST_ROWS", 100)
    placed([(r.doc_id, r.epoch, r.position) for r in mix.mix(df, schedules=plan, sort=False).collect()], want)


def test_mixing_meets_its_weights(spark):
    df = spark.createDataFrame([(i, "x" * 400, "abc"[i % 3]) for i in range(6_000)], "doc_id long, text string, source string")
    plan = {"a": [(0, 0.8), (1, 0.2)], "b": [(0, 0.1), (1, 0.1)], "c": [(0, 0.1), (1, 0.7)]}
    out = mix.mix(df, schedules=plan).collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert len(out) == pytest.approx(6_000, rel=0.03)
    early, late = (Counter(r.source for r in out if lo <= r.position < lo + 0.2) for lo in (0.0, 0.8))
    assert early["a"] / sum(early.values()) == pytest.approx(0.74, abs=0.04) and late["c"] / sum(late.values()) == pytest.approx(0.64, abs=0.04)
    assert max(r.epoch for r in out if r.source == "a") == 1 and max(r.epoch for r in out if r.source == "b") == 0


# ---- 9 ----


def test_quality_classifier(spark, awkward):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    test = labels.where("doc_id % 2 = 1")
    got = quality.score(docs.join(test.select("doc_id"), "doc_id", "left_semi"), model).join(test, "doc_id").toPandas()
    assert ((got.quality_score >= 0.5) == (got.quality == 1)).mean() > 0.95
    toxic = got[got.toxic == 1]
    assert (toxic.toxic_score >= 0.5).mean() > 0.8 and (got[got.toxic == 0].toxic_score < 0.5).mean() > 0.98
    X = np.random.default_rng(0).random((50, len(quality.FEATURES)))
    p = quality.predict(model["good"], X)
    for i in range(50):  # nothing but table entries is added
        s, m = model["good"]["base"], model["good"]
        b = [int(np.searchsorted(e, X[i, j], "right")) for j, e in enumerate(m["edges"])]
        s += sum(t[k] for t, k in zip(m["tables"], b))
        c = [min(k * quality.PAIR_BINS // max(1, len(t)), quality.PAIR_BINS - 1) for k, t in zip(b, m["tables"])]
        s += sum(t[c[x], c[y]] for (x, y), t in zip(m["pairs"], m["pair_tables"]))
        assert p[i] == pytest.approx(1 / (1 + np.exp(-s)))
    out = quality.score(awkward, model)
    assert out.columns == ["doc_id", "quality_score", "toxic_score", "keep"] and out.count() == len(TEXTS)
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == out.where("keep").count()
    assert quality.score(none(awkward), model).count() == 0


def test_fit_against_a_plain_version():
    """One round over two features and one pair, every split tried by brute force."""
    rng = np.random.default_rng(7)
    X = rng.integers(0, 6, (300, 2)).astype(float)
    y = (rng.random(300) < np.where((X[:, 0] > 2) ^ (X[:, 1] > 3), 0.9, 0.2)).astype(float)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "ROUNDS", 1)
        m.setattr(quality, "PAIR_ROUNDS", 1)
        m.setattr(quality, "PAIRS", 1)
        model = quality.fit(X, y)
    score = np.full(300, np.log(y.mean() / (1 - y.mean())))
    value = lambda rows, g, h: g[rows].sum() / (h[rows].sum() + 1)
    gain = lambda rows, g, h: g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for j in range(2):
        bins = np.searchsorted(model["edges"][j], X[:, j], "right")
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        parts = [(0, len(model["tables"][j]))]
        at = lambda a, z: (bins >= a) & (bins < z)  # noqa: B023, E731
        for _ in range(2):
            tries = [(gain(at(a, c), g, h) + gain(at(c, z), g, h) - gain(at(a, z), g, h), a, c, z) for a, z in parts for c in range(a + 1, z)]
            best = max(tries, key=lambda t: t[0])
            if best[0] > 1e-9:
                parts.remove((best[1], best[3]))
                parts += [(best[1], best[2]), (best[2], best[3])]
        step = np.zeros(len(model["tables"][j]))
        for a, z in parts:
            step[a:z] = quality.RATE * value(at(a, z), g, h)
        assert model["tables"][j] == pytest.approx(step)
        score += step[bins]
    c = [np.minimum(np.searchsorted(model["edges"][j], X[:, j], "right") * quality.PAIR_BINS // len(model["tables"][j]), quality.PAIR_BINS - 1) for j in range(2)]
    q = 1 / (1 + np.exp(-score))
    g, h = y - q, q * (1 - q)
    quarters = lambda i, j: [((c[0] < i) == u) & ((c[1] < j) == w) for u in (True, False) for w in (True, False)]
    i, j = max(((i, j) for i in range(1, quality.PAIR_BINS) for j in range(1, quality.PAIR_BINS)), key=lambda t: round(sum(gain(r, g, h) for r in quarters(*t)), 9))
    want = np.zeros(300)
    for r in quarters(i, j):
        want[r] = quality.RATE * value(r, g, h) if r.any() else 0.0
    assert model["pair_tables"][0][c[0], c[1]] == pytest.approx(want)


def test_quality_without_labels(spark, awkward):
    none_at_all = quality.train(awkward, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.keep_good(awkward, none_at_all).count() == len(TEXTS)
    odd = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(awkward, quality.train(awkward, odd)).count() == len(TEXTS)
    assert quality.keep_good(none(awkward), quality.train(none(awkward), odd)).count() == 0


# ---- 10 ----


@pytest.mark.parametrize("limit", [exact.TRIE_BYTES, 2_000])
def test_exact_dedup(spark, awkward, docs, rows, limit):
    got = exact.copies(awkward, limit)
    assert {tuple(r) for r in got.collect()} == brute.copies(TEXTS)
    got = [tuple(r) for r in exact.copies(docs, limit).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.copies([(r["doc_id"], r["text"]) for r in rows])
    assert exact.copies(none(awkward)).count() == 0


def test_trie_spills_by_subtree(tmp_path):
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    first = {}
    want = sorted((i, first[k]) for i, k in enumerate(keys) if first.setdefault(k, i) != i)
    for limit in (1 << 20, 20_000):
        trie = exact.Trie(f"file://{tmp_path}/t{limit}", limit)
        for i, k in enumerate(keys):
            trie.insert(k, [i])
        spilled = bool(trie.away)
        assert sorted(p for pairs in trie.settled() for p in pairs) == want and want
        assert spilled == (limit == 20_000)


def test_a_text_of_very_many_copies(spark):
    """Linear in the copies, and a terminal node keeps one id whatever their number."""
    n = 400_000
    df = spark.range(n).selectExpr("id + 7 AS doc_id", "'the same text' AS text").coalesce(1)
    out = exact.copies(df.unionByName(df), 1 << 20)  # twice the same rows
    assert out.count() == n - 1 == out.where("owner_id = 7").select("doc_id").distinct().count()
    trie = exact.Trie(limit=1_000)
    for k in range(0, 10_000, 100):
        trie.insert(b"x", list(range(k, k + 100)))
    assert trie.size < 1_000 and trie.root.kids[ord("x")].ids == [0]
