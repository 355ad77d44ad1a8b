"""Similarity joins over sets of trigrams, and phrases that grow towards a reference name.

`trigram_join` is exact. A pair with similarity s shares at least s / (1 + s) of both sets' grams, so
if each set is ordered by rarity, its first n - ceil(s n) + 1 grams must meet a gram of the other's
prefix: only these few rare grams are joined, frequent grams never become a join key, and sizes that
cannot reach s are left out before the sets are compared in full. Rarity counts come from the
reference side and bound nothing; they only choose the order.

Defined results: texts without a letter or digit match nothing; equal texts are joined once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.functions.text import edit_similarity, set_similarity, trigrams
from kernelweave.runtime import broadcast_if_small


def _prefixes(sets: DataFrame, ranks: DataFrame, key: str, bound: float) -> DataFrame:
    """key, grams, n and one row per gram of the prefix."""
    each = sets.select(key, F.explode("grams").alias("gram")).join(ranks, "gram", "left")
    ordered = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gram"))).alias("o"))
    n = F.size("o")
    head = (n - F.ceil(n * bound) + 1).cast("int")
    return ordered.select(key, n.alias("n"), F.explode(F.slice(F.col("o.gram"), F.lit(1), head)).alias("gram"), F.array_sort(F.col("o.gram")).alias("grams"))


def trigram_join(left: DataFrame, right: DataFrame, bound: float) -> DataFrame:
    """a, b, score of all pairs of distinct texts (`left.a`, `right.b`) with trigram similarity of at least `bound`."""
    x = left.select("a").where(F.col("a").isNotNull()).distinct().select("a", trigrams(F.col("a")).alias("grams")).where(F.size("grams") > 0)
    y = right.select("b").where(F.col("b").isNotNull()).distinct().select("b", trigrams(F.col("b")).alias("grams")).where(F.size("grams") > 0)
    ranks = broadcast_if_small(y.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("freq")), 100_000)
    heads = _prefixes(x, ranks, "a", bound)
    refs = _prefixes(y, ranks, "b", bound).select("b", F.col("n").alias("m"), "gram", F.col("grams").alias("grams_b"))
    fits = (F.col("m") >= F.col("n") * bound) & (F.col("n") >= F.col("m") * bound)
    met = heads.join(refs, "gram").where(fits).select("a", "b", set_similarity(F.col("grams"), F.col("grams_b")).alias("score"))
    return met.where(F.col("score") >= bound).distinct()


def ranked_matches(pairs: DataFrame) -> DataFrame:
    """Add `rank`: best score first, then the name."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b")))


def grown_phrase(first: Column, start: Column, rest: Column, name: Column) -> Column:
    """struct(text, score): the token and those that follow, as long as the similarity to `name` does not drop.

    `rest` holds the tokens that follow. Once the phrase is longer than length(name) / start, every
    further token lowers the similarity, so that many are enough for an exact result.
    """
    begin = F.struct(first.alias("text"), start.alias("score"), F.lit(1).alias("n"), F.lit(True).alias("grows"))

    def step(s: Column, token: Column) -> Column:
        longer = F.concat_ws(" ", s["text"], token)
        score = edit_similarity(longer, name)
        grows = s["grows"] & (score >= s["score"])
        return F.struct(
            F.when(grows, longer).otherwise(s["text"]).alias("text"), F.when(grows, score).otherwise(s["score"]).alias("score"), F.when(grows, s["n"] + 1).otherwise(s["n"]).alias("n"), grows.alias("grows")
        )

    return F.aggregate(rest, begin, step)


def extend_phrases(tokens: DataFrame, names: DataFrame, recall: float, precision: float) -> DataFrame:
    """text_id, pos, phrase, name, score of runs of tokens that come close to a name.

    `tokens` has text_id and tokens (array of lower-case tokens), `names` has name. Tokens are matched as
    distinct words, by trigrams and then by edits; only words that meet a name are looked up in the texts.
    A text is cut into overlapping blocks, as wide as a phrase can get, so a token's row holds its block and
    never its whole text.
    """
    longest = names.agg(F.max(F.length("name"))).first()[0] or 1
    width = math.ceil(longest / recall) + 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(width))
    blocks = F.transform(starts, lambda k: F.struct(k.alias("at"), F.slice("tokens", k + 1, 2 * width).alias("part")))
    flat = tokens.select("text_id", F.inline(blocks)).select("text_id", "at", "part", F.posexplode(F.slice("part", 1, width)).alias("k", "a"))
    pairs = trigram_join(flat.select("a"), names.select(F.col("name").alias("b")), recall)
    pairs = pairs.withColumn("score", edit_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= recall)
    met = flat.join(broadcast_if_small(pairs, 50_000), "a")
    most = F.ceil(F.length("b") / F.col("score")).cast("int") + 1
    grown = grown_phrase(F.col("a"), F.col("score"), F.slice("part", F.col("k") + 2, most), F.col("b"))
    out = met.select("text_id", (F.col("at") + F.col("k")).alias("pos"), F.col("b").alias("name"), grown.alias("g"))
    return out.where(F.col("g.score") >= precision).select("text_id", "pos", F.col("g.n").alias("n_tokens"), F.col("g.text").alias("phrase"), "name", F.col("g.score").alias("score"))
