"""Joins and cuts over character spans.

Spans of one text are joined in blocks of positions: each span is listed under the blocks it touches, so
a text with very many spans is spread over its blocks and is never one task's work, and a pair is kept in the
first block that both touch. Defined results: spans with a null end take no part; ends that touch
count as overlapping (closed intervals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.functions.text import TOKEN

BLOCK = 64
MOST_SPECIFIC = ("verb", "gpe", "loc", "org", "noun", "entity", "adjective")
SHOWN = {"verb": "verb", "gpe": "GPE", "loc": "LOC", "org": "ORG", "noun": "noun", "entity": "ENTITY", "adjective": "JJ"}
PARENT_TYPE = {"ENTITY": None, "NOUN": "ENTITY", "JJ": "ENTITY", "ORG": "NOUN", "PERSON": "NOUN", "LOC": "NOUN", "GPE": "LOC"}


def _blocked(df: DataFrame, begin: str, end: str, first: str) -> DataFrame:
    low, high = (F.floor(F.col(c) / BLOCK).cast("long") for c in (begin, end))
    spans = df.where(F.col(begin).isNotNull() & F.col(end).isNotNull() & (F.col(begin) <= F.col(end)))
    return spans.withColumn(first, low).withColumn("block", F.explode(F.sequence(low, high)))


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """All pairs of one `key` whose closed spans overlap; other columns must differ in name."""
    x, y = _blocked(a, *a_span, "__a"), _blocked(b, *b_span, "__b")
    met = x.join(y, [key, "block"]).where(F.col("block") == F.greatest("__a", "__b"))
    return met.where((F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1]))).drop("block", "__a", "__b")


def most_specific(kinds: Column) -> Column:
    """The type of highest precedence in an array of types: verb, GPE, LOC, ORG, noun, ENTITY, JJ, else None."""
    low = F.transform(kinds, F.lower)
    out = F.when(F.exists(low, lambda x: x.contains("verb")), "verb")
    for kind in MOST_SPECIFIC[1:]:
        out = out.when(F.array_contains(low, kind), SHOWN[kind])
    return out.otherwise("None")


def _ancestry(kind: str) -> list[str]:
    out = []
    while kind:
        out, kind = [kind, *out], PARENT_TYPE[kind]
    return out


def most_general(kinds: Column) -> Column:
    """Lowest common ancestor of an array of types in the tree of types; null for an unknown type or none.

    A single type is its own ancestor, known or not.
    """
    up = F.transform(kinds, F.upper)
    paths = F.create_map(*[x for kind in PARENT_TYPE for x in (F.lit(kind), F.array(*map(F.lit, _ancestry(kind))))])
    own = F.transform(up, lambda k: F.try_element_at(paths, k))
    common = F.aggregate(own, F.get(own, F.lit(0)), lambda s, p: F.filter(s, lambda x: F.array_contains(p, x)))
    known = ~F.exists(own, lambda p: p.isNull())
    return F.when(F.size(F.array_distinct(up)) == 1, F.get(up, F.lit(0))).when(known & (F.size(common) > 0), F.get(common, F.size(common) - 1))


def best_at_span(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, confidence (the best), kinds (distinct types that have it) and n; aggregated before any join."""
    top = mentions.groupBy(*keys, "type").agg(F.max("confidence").alias("c"), F.count(F.lit(1)).alias("n"))
    best = top.groupBy(*keys).agg(F.max("c").alias("confidence"), F.sum("n").alias("n"), F.collect_list(F.struct("c", "type")).alias("each"))
    held = F.filter("each", lambda x: x["type"].isNotNull() & x["c"].eqNullSafe(F.col("confidence")))
    return best.select(*keys, "confidence", F.array_sort(F.transform(held, lambda x: x["type"])).alias("kinds"), "n")


def token_spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, begin, end of every word and every other character, blanks left out."""
    parts = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    each = texts.select(key, F.posexplode(parts).alias("__k", "token"))
    before = F.sum(F.length("token")).over(Window.partitionBy(key).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1))
    placed = each.withColumn("begin", F.coalesce(before, F.lit(0))).withColumn("end", F.col("begin") + F.length("token"))
    return placed.where(F.trim("token") != "").select(key, "token", "begin", "end")


def stitch_hyphens(tokens: DataFrame, key: str) -> DataFrame:
    """key, text, begin, end of words that a hyphen joins: the left one ends where it begins, the right one begins where it ends."""
    word = tokens.where(F.col("token").rlike(r"^[\p{L}\p{N}]+$"))
    left = word.select(key, F.col("token").alias("left"), F.col("begin").alias("from"), F.col("end").alias("begin"))
    right = word.select(key, F.col("token").alias("right"), F.col("begin").alias("end"), F.col("end").alias("to"))
    hyphens = tokens.where(F.col("token") == "-").select(key, "begin", "end")
    met = hyphens.join(left, [key, "begin"]).join(right, [key, "end"])
    return met.select(key, F.concat_ws("-", "left", "right").alias("text"), F.col("from").alias("begin"), F.col("to").alias("end"))


def segments(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, begin, end, piece, covered: the text cut at every boundary of a span.

    Distinct boundaries are taken first, so a text's boundaries are no more than its characters. `texts` has
    key and text, `spans` has key, begin and end (half open); boundaries outside a text are moved to its ends.
    """
    inside = spans.where("begin IS NOT NULL AND end IS NOT NULL AND begin < end").join(texts.select(key, F.length("text").alias("n")), key)
    inside = inside.select(key, "n", F.least("n", F.greatest("begin", F.lit(0))).alias("begin"), F.least("n", "end").alias("end"))
    ends = inside.select(key, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("b")).select(key, "b.at", "b.step")
    outer = texts.select(key, F.explode(F.array(F.lit(0), F.length("text"))).alias("at")).select(key, "at", F.lit(0).alias("step"))
    cuts = ends.unionByName(outer).groupBy(key, "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(key).orderBy("at")
    cuts = cuts.select(key, F.col("at").alias("begin"), F.lead("at").over(order).alias("end"), (F.sum("step").over(order) > 0).alias("covered"))
    met = cuts.where(F.col("end").isNotNull()).join(texts.select(key, "text"), key)
    return met.select(key, "begin", "end", F.col("text").substr(F.col("begin") + 1, F.col("end") - F.col("begin")).alias("piece"), "covered")


def best_per_node(pairs: DataFrame, node: list[str], order: list[Column]) -> DataFrame:
    """The first row of every node by `order`."""
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy(*node).orderBy(*order))).where("__r = 1").drop("__r")
