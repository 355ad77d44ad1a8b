"""Records that are equal but for blanks, letter case, punctuation or the order of two fields.

Byte-identical rows are collapsed first, by a map-side aggregate that absorbs hot copies; only the
distinct survivors are put into canonical form, and a second aggregate on the full canonical text
sums their counts. Variants, facts and their links are each written once to the shared folder and read from
there. Members are attached with joins that keep hot keys out of single tasks.

Defined results: rows with a null in any of the four fields take no part; fields that are all blanks
and punctuation are equal to each other; accents count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.llm.skew import attach
from kernelweave.runtime import broadcast_if_small, cut

RAW = ["lang", "rel", "surface_start", "surface_end"]
FACT = ["lang", "rel", "a", "b"]


def canonical(text: Column) -> Column:
    """Text without blanks, control characters and punctuation, in one letter case."""
    return F.regexp_replace(F.lower(F.upper(text)), r"[\s\p{Z}\p{C}\p{P}]+", "")


def collapse(rows: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, facts): distinct raw forms with their canonical key, and one row per fact.

    `rows` has rel_id and the four fields; `relations` has label and is_symmetric.
    """
    whole = rows.select("rel_id", *RAW).na.drop(subset=RAW)
    variants = whole.groupBy(*RAW).agg(F.count(F.lit(1)).alias("n"), F.min("rel_id").alias("first"))
    either = broadcast_if_small(relations.where("is_symmetric").select(F.col("label").alias("rel"), F.lit(True).alias("either")).distinct())
    variants = variants.join(either, "rel", "left").withColumns({"x": canonical(F.col("surface_start")), "y": canonical(F.col("surface_end"))})
    swap = F.col("either") & (F.col("x") > F.col("y"))
    variants = variants.select(*RAW, "n", "first", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"))
    variants = cut(variants)
    best = F.min(F.struct("first", "surface_start", "surface_end"))
    facts = variants.groupBy(*FACT).agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("variants"), best.alias("best"))
    return variants, facts


def collapsed_facts(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per fact: its first record, that record's wording and the number of copies."""
    facts = collapse(rows, relations)[1]
    return facts.select(F.col("best.first").alias("rel_id"), "lang", "rel", F.col("best.surface_start").alias("surface_start"), F.col("best.surface_end").alias("surface_end"), "copies", "variants")


def duplicate_members(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """rel_id_a (smallest of the fact) with every other rel_id_b of the same fact."""
    variants, facts = collapse(rows, relations)
    facts = cut(facts.where(F.col("copies") > 1).select(*FACT, "variants", F.col("best.first").alias("rel_id_a")))
    linked = cut(attach(variants, facts, FACT, "variants").select(*RAW, "n", "first", "rel_id_a"))
    single = linked.where(F.col("n") == 1).select("rel_id_a", F.col("first").alias("rel_id_b"))
    many = attach(rows.select("rel_id", *RAW).na.drop(subset=RAW), linked.where(F.col("n") > 1), RAW, "n").select("rel_id_a", F.col("rel_id").alias("rel_id_b"))
    return single.unionByName(many).where(F.col("rel_id_a") != F.col("rel_id_b"))
