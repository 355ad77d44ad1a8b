"""Texts that were cut by a field limit or in transfer.

Limits: the length of every document is computed under several encodings (characters, UTF-8 and UTF-16
bytes, entity and JSON escaping, newline conversion) and distinct texts are counted by (source,
encoding, length); a length where unfinished ones pile up and that few texts exceed is that source's limit. Endings: a mark of omission or
a broken character shows a cut; trailers, references, tags and closed sentences are complete; an open line
that follows a closed sentence is cut. What remains (headings, lists, unpunctuated lines) is cut at a
limit, or where its last word never ends a line in the corpus although it occurs, or is only the
beginning of other words.

Defined results: null, empty and blank texts are no cases; a text without source is held against the exact
limits of all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.runtime import broadcast_if_small, cut

PILE = 3
SHORTEST_LIMIT = 100
WORD_WIDTH = 12
_ENCODINGS = ("chars", "utf8", "utf16", "entities", "json", "crlf")
_CLOSE = r"""["”“»’')\]]*"""
_MARK = r"(?:…|\.\.\.|\[(?:\.\.\.|…)\]|\((?:more|cont\.?|continued)\)|\[(?:truncated|cut)\]|\x{FFFD})$"
_SIGN = r"Sent from \p{L}+ \d+|Filed by \p{L}+|(?:#\S+\s*)+|[^\p{L}\p{N}&<(\x{FFFD}]+"
_TRAILER = rf"(?:(?:^|\s)(?:\*{{3,}}|\(end\)|\[\d+ photos?\]|https?://\S+|Ref\. ?\d+/\d+|--? \p{{L}}+, desk \d+)|^(?:{_SIGN})|[.!?]{_CLOSE}\s+(?:{_SIGN}))$"
_BROKEN_END = r"\(approx\.$|(?:^|\s)v\d+(?:\.\d+)?\.$"
_INSIDE = rf"""[.!?…]{_CLOSE}\s+["“«„'‘(¿¡]*\p{{Lu}}"""
_ITEM = r"^\s*(?:\d+[.)]|[-*•–])\s+"


_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WORD = r"[\p{L}\p{M}\p{N}'’]+"


def _ends(text: Column) -> Column:
    return text.rlike(rf"[.!?]{_CLOSE}$") & ~text.rlike(rf"& co\.$|{_BROKEN_END}")


def _plain(text: Column) -> Column:
    """Text with one kind of line end, without blanks at its end."""
    return F.rtrim(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(_BLANKS))


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def encoded_lengths(text: Column) -> Column:
    """Array of (encoding, n) of a text; every encoding is counted by literal signs, in passes without patterns."""
    lengths = {
        "chars": F.length(text),
        "utf8": F.octet_length(text),
        "utf16": F.octet_length(F.encode(text, "UTF-16BE")) / 2,
        "entities": F.length(text) + 4 * _count(text, "&") + 3 * _count(text, "<>") + 5 * _count(text, "\"'"),
        "json": F.length(text) + _count(text, '"\\\n\r\t'),
        "crlf": F.length(text) + _count(F.replace(text, F.lit("\r\n"), F.lit("")), "\n"),
    }
    return F.array(*[F.struct(F.lit(name).alias("encoding"), n.cast("int").alias("n")) for name, n in lengths.items()])


def limits(texts: DataFrame) -> DataFrame:
    """source, encoding, low, high: the lengths at which a source's unfinished texts pile up.

    `texts` has source, digest (of the text), sizes (its encoded lengths) and unfinished. Copies of a text count
    once. A limit is a length that few of the source's texts exceed and where unfinished ones pile up: exactly there
    (UTF-8 may lack a broken character, other encodings a blank), or, where cuts fall between words, within a
    word's width below. The encoding with the highest pile explains the source. Lengths are counted
    before they are compared, so a source of any size is a short table.
    """
    once = texts.groupBy("source", "digest").agg(F.first("sizes").alias("sizes"), F.max(F.col("unfinished").cast("int")).alias("u"))
    counts = once.select("source", "u", F.inline("sizes")).groupBy("source", "encoding", "n").agg(F.count(F.lit(1)).alias("c"), F.sum("u").alias("u"))
    own = Window.partitionBy("source", "encoding").orderBy("n")
    upto = counts.withColumns({
        "beyond": F.coalesce(F.sum("c").over(Window.partitionBy("source", "encoding").orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "near": F.sum("u").over(own.rangeBetween(1 - WORD_WIDTH, 0)),
        "before": F.coalesce(F.sum("u").over(own.rangeBetween(-4 * WORD_WIDTH, -WORD_WIDTH)), F.lit(0)),
    }).where(F.col("n") >= SHORTEST_LIMIT)
    exact = (F.col("u") >= PILE) & (F.col("beyond") <= F.col("u")) & (2 * F.col("u") >= F.col("near"))
    wide = (F.col("near") >= 2 * PILE) & (3 * F.col("beyond") <= F.col("near")) & (3 * F.col("near") >= 4 * F.col("before"))
    rank = F.array_position(F.array(*map(F.lit, _ENCODINGS)), F.col("encoding"))
    found = upto.where(exact | wide).withColumn("height", F.when(exact, F.col("u") + F.col("near")).otherwise(F.col("near") - F.col("beyond")))
    slack = F.when(~exact, WORD_WIDTH - 1).when(F.col("encoding") == "utf8", 3).otherwise(1)
    best = found.groupBy("source").agg(F.min(F.struct((-F.col("height")).alias("height"), rank.alias("rank"), "n", "encoding", slack.alias("slack"), exact.alias("exact"))).alias("b"))
    sourced = best.select("source", "b.encoding", (F.col("b.n") - F.col("b.slack")).alias("low"), F.col("b.n").alias("high"), "b.exact")
    anywhere = sourced.where("exact AND source IS NOT NULL").select(F.lit(None).cast("string").alias("source"), "encoding", F.col("high").alias("low"), "high").distinct()
    return sourced.where("source IS NOT NULL").select("source", "encoding", "low", "high").unionByName(anywhere)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, sizes, last word and verdict (cut, whole or open) by the text's ending alone; texts themselves are let go."""
    whole = docs.select("doc_id", "source", F.md5("text").alias("digest"), encoded_lengths(F.col("text")).alias("sizes"), _plain(F.col("text")).alias("t")).where("t <> ''")
    stripped = F.filter(F.transform(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    lines = whole.select("doc_id", "source", "digest", "sizes", F.slice(F.reverse(stripped), 1, 2).alias("l"))
    lines = lines.select("doc_id", "source", "digest", "sizes", F.get("l", F.lit(0)).alias("raw"), F.coalesce(F.get("l", F.lit(1)), F.lit("")).alias("previous"))
    last = F.regexp_replace("raw", r"& co\. ", "& co ")
    item = last.rlike(_ITEM)
    bare = F.regexp_replace(last, _ITEM, "")
    verdict = (
        F.when(F.col("raw").rlike(_MARK), "cut")
        .when(last.rlike(_TRAILER) | _ends(F.col("raw")), "whole")
        .when(bare.rlike(_INSIDE) | (~item & _ends(F.col("previous"))) | bare.rlike(_BROKEN_END) | bare.rlike(r"& co\.$|&\w*$|<\w*>?$|\bw/$|[,(]$"), "cut")
        .otherwise("open")
    )
    word = F.lower(F.regexp_extract("raw", rf"({_WORD})[^\p{{L}}\p{{N}}]*$", 1))
    return lines.select("doc_id", "source", "digest", "sizes", word.alias("word"), verdict.alias("verdict"))


def line_words(docs: DataFrame) -> DataFrame:
    """word, n (occurrences) and ends (as the last word of a closed sentence or of a line that others follow), over whole texts."""
    text = F.lower(_plain(F.regexp_replace(_plain(F.col("text")), _MARK, "")))
    every = F.transform(F.regexp_extract_all("t", F.lit(_WORD), F.lit(0)), lambda w: F.struct(w.alias("word"), F.lit(0).alias("e")))
    closing = F.regexp_extract_all("t", F.lit(rf"({_WORD})[^\p{{L}}\p{{N}}\n]*?(?:[.!?]{_CLOSE}(?=\s|$)|\n)"), F.lit(1))
    each = docs.select(text.alias("t")).select(F.explode(F.concat(every, F.transform(closing, lambda w: F.struct(w.alias("word"), F.lit(1).alias("e"))))).alias("x"))
    return each.groupBy("x.word").agg(F.sum(1 - F.col("x.e")).alias("n"), F.sum("x.e").alias("ends"))


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id of every text that was cut; `docs` has doc_id, source and text. Texts are read twice: for their endings and for the words of lines."""
    judged = cut(judge(docs))
    unsure = judged.where("verdict = 'open'")
    lim = broadcast_if_small(limits(judged.withColumn("unfinished", F.col("verdict") != "whole")))
    lim = lim.select(F.col("source").alias("s"), F.col("encoding").alias("e"), "low", "high")
    sizes = unsure.select("doc_id", "source", F.inline("sizes"))
    at_limit = sizes.join(lim, F.col("source").eqNullSafe(F.col("s")) & (F.col("encoding") == F.col("e")) & F.col("n").between(F.col("low"), F.col("high")), "left_semi").select("doc_id")
    words = cut(line_words(docs))
    asked = unsure.select("word").where("word <> ''").distinct()
    never = words.join(asked, "word").where("ends * 50 < n AND n >= 5").select("word")
    rare = words.join(asked, "word").where("ends = 0 AND n < 5").select("word")
    starts = "transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))"
    heads = words.where("n >= 2 AND length(word) > 1").select(F.explode(F.expr(starts)).alias("word")).distinct()
    fragments = rare.join(heads, "word", "left_semi").select("word")
    by_word = unsure.join(broadcast_if_small(never.unionByName(fragments), 100_000), "word", "left_semi").select("doc_id")
    return judged.where("verdict = 'cut'").select("doc_id").unionByName(at_limit).unionByName(by_word).distinct()


def share_by_source(docs: DataFrame) -> DataFrame:
    """source, n_documents, n_cut and share of every source."""
    marked = docs.select("doc_id", "source").join(truncated(docs).withColumn("cut", F.lit(1)), "doc_id", "left")
    n, cut_ones = F.count(F.lit(1)), F.count("cut")
    return marked.groupBy("source").agg(n.alias("n_documents"), cut_ones.alias("n_cut"), (cut_ones / n).alias("share"))
