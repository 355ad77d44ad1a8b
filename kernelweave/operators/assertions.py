"""Assertion rows as compact and full relations, relation mapping, and vocabulary checks.

Rows come from the loaded side of `operators.malformed`; here the JSON field is read and the concept
addresses are cut. Defined results: a surface that the data lacks is made from the concept's address; a data
text with doubled escapes is read once more with these repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA = "surfaceStart string, surfaceEnd string, surfaceText string, weight string, dataset string, license string, sources array<string>"


def _part(address: Column, k: int) -> Column:
    return F.get(F.split(address, "/"), F.lit(k))


def _read(text: Column) -> Column:
    """The data object; where it cannot be read as it stands, with escapes of quotes undone."""
    sound = F.try_parse_json(text).isNotNull()
    return F.when(sound, F.from_json(text, DATA)).otherwise(F.from_json(F.replace(text, F.lit('\\\\"'), F.lit('\\"')), DATA))


def compact(rows: DataFrame) -> DataFrame:
    """line_id, lang, surface_start, rel, surface_end, weight, dataset of loaded assertion rows."""
    data = _read(F.col("data"))
    read = rows.withColumn("__d", data)
    word = lambda c: F.replace(_part(F.col(c), 3), F.lit("_"), F.lit(" "))
    surface = lambda key, c: F.coalesce(F.nullif(F.trim(F.col(f"__d.{key}")), F.lit("")), word(c), F.col(c))
    return read.select(
        "line_id",
        F.when(F.col("start_id").startswith("/c/"), _part(F.col("start_id"), 2)).alias("lang"),
        surface("surfaceStart", "start_id").alias("surface_start"),
        F.regexp_replace("relation_id", "^/r/", "").alias("rel"),
        surface("surfaceEnd", "end_id").alias("surface_end"),
        F.coalesce(F.col("__d.weight").try_cast("double"), F.col("weight")).alias("weight"),
        F.regexp_replace("__d.dataset", "^/d/", "").alias("dataset"),
    )


def full(rows: DataFrame) -> DataFrame:
    """line_id, uri, rel, both ends cut into language, term and sense, weight and number of sources."""
    read = rows.withColumn("__d", _read(F.col("data")))
    end = lambda c, name: [F.when(F.col(c).startswith("/c/"), _part(F.col(c), k)).alias(f"{name}_{part}") for k, part in ((2, "lang"), (3, "term"), (4, "sense"))]
    return read.select("line_id", "uri", F.regexp_replace("relation_id", "^/r/", "").alias("rel"), *end("start_id", "start"), *end("end_id", "end"), "weight", F.coalesce(F.size("__d.sources"), F.lit(0)).alias("n_sources"))


def of_language(relations: DataFrame, lang: str) -> DataFrame:
    """Distinct triples of one language."""
    return relations.where(F.col("lang") == lang).select("surface_start", "rel", "surface_end").distinct()


def surface_forms(relations: DataFrame, key: Column) -> DataFrame:
    """key, n_forms, first: the surface forms that stand for one key; forms are counted, never gathered."""
    forms = relations.select(key.alias("key"), F.col("surface_start").alias("form")).where("key IS NOT NULL").groupBy("key", "form").agg(F.lit(1).alias("one"))
    return forms.groupBy("key").agg(F.count(F.lit(1)).alias("n_forms"), F.min("form").alias("first"))


def outside_vocabulary(surfaces: DataFrame, words: DataFrame) -> DataFrame:
    """Distinct lower-case surfaces (column `surface`) that are not among `words` (column `word`)."""
    lower = surfaces.select(F.lower("surface").alias("surface")).where("surface IS NOT NULL").distinct()
    return lower.join(words.select(F.lower("word").alias("surface")).distinct(), "surface", "left_anti")


def map_relations(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations with the mapped relation and its negation; unmapped ones keep their label and are marked. `mapping` is small and broadcast."""
    known = F.broadcast(mapping.select(F.col("label").alias("rel"), F.col("rel").alias("mapped"), "rel_negated").dropDuplicates(["rel"]))
    met = relations.join(known, "rel", "left")
    return met.select("*", F.coalesce("mapped", "rel").alias("relation"), F.coalesce("rel_negated", F.lit(False)).alias("negated"), F.col("mapped").isNull().alias("unmapped")).drop("mapped", "rel_negated")


def without_identifiers(relations: DataFrame) -> DataFrame:
    """Rows of which neither surface is an item number (`Q` and digits)."""
    number = lambda c: F.coalesce(F.col(c).rlike("^Q[0-9]+$"), F.lit(False))
    return relations.where(~number("surface_start") & ~number("surface_end"))
