"""Normalisation, tokens and chunks as Catalyst expressions; only the sentence-aware chunker's walk is a fold, and that is in-row too.

Lengths and offsets are code points. Null in, null out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = " . . . "
CJK_TOKENS = ("zh", "ko", "ja")
CJK_LANGS = ("zh", "zh-classical", "zh-min-nan", "zh-yue", "ko", "ja", "th")
SCRIPTS = (("zh", "[\\x{4E00}-\\x{9FFF}]"), ("ko", "[\\x{AC00}-\\x{D7A3}]"), ("ja", "[\\x{3040}-\\x{30FF}]"), ("th", "[\\x{0E01}-\\x{0E5B}]"))
EMOJI = "[\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}]+"
#: Sentence marks, and characters that are stripped from the ends of mentions. Both sets are our own: only their use is known.
MARKS = "?.!।;:,。！？；：、，．؟"
STRIP = " ,،、{}[]|()\"'“”《》«»!?.:;।。！？…*-–—_/\\\t\n"
_SPACING = (("．", "． "), ("、", "、 "), ("《", " 《"), ("》", "》 "), ("’s", " 's"), ("`s", " 's"), ("'s", " 's"), ("  ", " "))
_FOLD_FROM, _FOLD_TO = "。،、`“”《》«»", ".,,'\"\"\"\"\"\""
SPACE = "(?U)\\s+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(numbers: Column, block: int = 256) -> Column:
    """array<int> of the sums up to and with each number. Folds over blocks, so long arrays don't cost the square of their length."""

    def whole(x: Column) -> Column:
        count = F.floor((F.size(x) + block - 1) / block).cast("int")
        blocks = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda b: F.slice(x, b * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<int>>"))
        return let(blocks, offset)

    def offset(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
        return let(F.aggregate(totals, F.array(F.lit(0)), lambda acc, t: F.array_append(acc, F.element_at(acc, -1) + t)), lambda first: F.flatten(F.transform(blocks, lambda x, b: inside(x, F.get(first, b)))))

    def inside(x: Column, first: Column) -> Column:
        sums = F.aggregate(x, F.array(first), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))
        return F.slice(sums, F.lit(2), F.lit(block))

    return let(numbers, whole)


def with_pieces(c: Column, spans: Column, block: int = 1024) -> Column:
    """``spans`` (array<struct<start, end, votes>>) with ``piece``, what the text has there. The text is cut into blocks in one pass, so a piece doesn't cost the way to it from the text's start."""

    def cut(blocks: Column) -> Column:
        def piece(s: Column) -> Column:
            first, last = (F.greatest(F.floor(x / block).cast("int"), F.lit(0)) for x in (s["start"], s["end"] - 1))
            near = F.when(first == last, F.get(blocks, first)).otherwise(F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), ""))
            return F.substring(near, s["start"] - first * block + 1, F.greatest(s["end"] - s["start"], F.lit(0)))

        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), piece(s).alias("piece"), s["votes"].alias("votes")))

    return let(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), cut)


def replace_all(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_brackets(c: Column) -> Column:
    """Square brackets, which mark mentions in translation, become round ones."""
    return replace_all(c, (("[", "("), ("]", ")")))  # by bytes; a translation looks every character up


def space_marks(c: Column) -> Column:
    """Spaces round wide marks and before a genitive s; one pass over double spaces."""
    return replace_all(c, _SPACING)


def normalize(c: Column) -> Column:
    return space_marks(escape_brackets(c))


def fold_quotes(c: Column) -> Column:
    """Wide marks and curly quotes as plain ones, character by character, so offsets stay."""
    return F.translate(c, _FOLD_FROM, _FOLD_TO)


def mask_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", "1" * 10)


def strip_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def strip_space(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def script(c: Column) -> Column:
    """zh, ko, ja or th by the first script found, in this order; null for others."""
    return reduce(lambda rest, s: F.when(c.rlike(s[1]), s[0]).otherwise(rest), reversed(SCRIPTS), F.lit(None).cast("string"))


def is_cjk(lang: Column) -> Column:
    return lang.isin(*CJK_LANGS)


def words(c: Column) -> Column:
    """Runs without Unicode white space."""
    return F.filter(F.split(c, SPACE), lambda x: x != "")


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def tokens(c: Column, lang: Column) -> Column:
    """Characters in Chinese, Korean and Japanese, words elsewhere."""
    return F.when(lang.isin(*CJK_TOKENS), characters(c)).otherwise(words(c))


def _in(c: Column, chars: str) -> Column:
    return F.contains(F.lit(chars), c) & (c != "")


def split_glued(tokens: Column, marks: str = MARKS, strip: str = STRIP) -> Column:
    """Two sentences that were written without a space between them become two tokens, cut after the first mark."""

    one = "[" + "".join("\\" + m if m in "]^-\\[" else m for m in marks) + "]"
    other = "[^" + one[1:]

    def cut(t: Column) -> Column:
        # only a token with a mark inside and none at its end is looked at more closely
        parts = F.struct(F.regexp_extract(t, f"(?s)^({other}*)", 1).alias("head"), F.regexp_extract(t, one, 0).alias("mark"))
        return F.when(t.rlike(f"(?s){one}.*{other}$"), let(parts, lambda x: pieces(t, x["head"], x["mark"]))).otherwise(F.array(t))

    def pieces(t: Column, head: Column, mark: Column) -> Column:
        n = F.length(head)
        # the last occurrence of the first mark: what stands on its two sides
        before, after = F.right(F.split_part(t, mark, F.lit(-2)), F.lit(1)), F.left(F.split_part(t, mark, F.lit(-1)), F.lit(1))
        initial = F.left(t, F.lit(1))
        ok = (~mark.isin(".", "。")) | (~initial.rlike("[0-9]") & (initial == F.lower(initial))) | _in(before, strip) | _in(after, strip)
        following = F.substring(t, n + 2, F.lit(1))
        return F.when(ok & (following == F.upper(following)), F.array(F.substring(t, F.lit(1), n + 1), F.substring(t, n + 2, F.length(t)))).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, cut))


def chunk_ends(tokens: Column, cjk: Column, size: int = 70, marks: str = MARKS) -> Column:
    """Number of tokens up to the end of each chunk: the first token from the ``size``-th on that ends with a mark, at most 2 * size + 2 tokens.

    One fold over the tokens with their number in the open chunk; the rest is the last chunk. No tokens, no chunks.
    """
    n = F.size(tokens)
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("from"), F.lit(0).alias("i"))

    def step(acc: Column, t: Column) -> Column:
        j = acc["i"] - acc["from"]  # place within the chunk
        ends = F.when(cjk, _in(t, marks + " ")).otherwise(_in(F.right(t, F.lit(1)), marks))
        # a chunk begins only while more than ``size`` tokens are left
        close = (n - acc["from"] > size) & (j >= size - 1) & (ends | (j > 2 * size))
        i = acc["i"] + 1
        return F.struct(F.when(close, F.array_append(acc["ends"], i)).otherwise(acc["ends"]).alias("ends"), F.when(close, i).otherwise(acc["from"]).alias("from"), i.alias("i"))

    folded = F.aggregate(tokens, start, step, lambda a: a["ends"])
    return let(folded, lambda ends: F.when((n == 0) | (F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) == n), ends).otherwise(F.array_append(ends, n)))


def chunks(docs: DataFrame, size: int = 70, marks: str = MARKS, text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, chunk_no, chunk_text, char_offset, n_units) of normalised documents; offsets refer to the rejoined tokens."""
    cjk = F.col("lang").isin(*CJK_TOKENS)
    base = docs.select("doc_id", F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit(MISSING)).alias("t"))
    base = base.select("doc_id", "lang", F.when(cjk, characters(normalize(F.col("t")))).otherwise(split_glued(words(normalize(F.col("t"))), marks)).alias("toks"))
    base = base.withColumn("ends", chunk_ends(F.col("toks"), F.coalesce(cjk, F.lit(False)), size, marks))
    sep = F.when(cjk, "").otherwise(" ")
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1))
    texts = F.transform("ends", lambda e, k: F.array_join(F.slice("toks", begin(k) + 1, e - begin(k)), ""))
    texts = F.when(cjk, texts).otherwise(F.transform("ends", lambda e, k: F.array_join(F.slice("toks", begin(k) + 1, e - begin(k)), " ")))
    gap = F.length(sep)
    lengths = F.transform("texts", lambda x: F.length(x) + gap)
    offsets = F.aggregate("lengths", F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    base = base.withColumn("texts", texts).withColumn("lengths", lengths).withColumn("offsets", offsets)
    # an outer explode with a filter after it: for an inner one, a filter on the array's size would be inferred that works all of this out twice
    rows = base.select("doc_id", "lang", "offsets", "ends", F.posexplode_outer("texts").alias("chunk_no", "chunk_text")).where("chunk_text is not null")
    k = F.col("chunk_no")
    return rows.select("doc_id", "lang", k, "chunk_text", F.get("offsets", k).alias("char_offset"), (F.get("ends", k) - begin(k)).alias("n_units"))


def join_chunks(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """(doc_id, lang, text): chunks put together again in their order, a space between them outside Chinese, Korean and Japanese."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.col(text).alias("t")))), lambda x: x["t"])
    sep = F.col("lang").isin(*CJK_TOKENS)
    return chunks.groupBy("doc_id", "lang").agg(ordered.alias("parts")).select("doc_id", "lang", F.when(sep, F.array_join("parts", "")).otherwise(F.array_join("parts", " ")).alias("text"))


def with_defaults(docs: DataFrame, lang: str, domain: str = "") -> DataFrame:
    """Missing text, language and domain filled in; absent columns are added."""
    for column, value in (("text", MISSING), ("lang", lang), ("domain", domain)):
        known = F.col(column) if column in docs.columns else F.lit(None).cast("string")
        docs = docs.withColumn(column, F.coalesce(known, F.lit(value)))
    return docs


def merge_subwords(pieces: Column) -> Column:
    """Pieces of a subword tokenizer as tokens: neighbours without Chinese, Japanese, Korean or Thai characters are joined, ▁ begins a word."""
    wide = "[" + "".join(p[1:-1] for _, p in SCRIPTS) + "]"

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        glue = (F.size(acc) > 0) & ~p.startswith("▁") & ~p.rlike(wide) & ~last.rlike(wide)
        plain = F.replace(p, F.lit("▁"), F.lit(""))
        return F.when(glue, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.concat(last, plain))).otherwise(F.array_append(acc, plain))

    return F.filter(F.aggregate(pieces, F.array().cast("array<string>"), step), lambda x: x != "")
