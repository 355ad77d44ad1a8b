"""Readers for the formats that feed the engine. Every reader yields a lazy table with an explicit schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GSM_SCHEMA = (
    "id: bigint, ell: array<string>, xi: array<string>, properties: map<string, string>, "
    "phi: array<struct<containment: string, content: bigint, properties: map<string, string>, score: struct<parent: bigint, label: string, child: bigint, id: bigint>>>"
)
GAZETTEER_SCHEMA = "id int, idx string, t string, type string"
PREPOSITION_FLAGS = ("canOmit", "alwaysOmit", "alwaysTakeInfinitive", "superlative", "comparative", "isPrototypical", "isDependant", "isIdiomatic", "isComplex")


def sentences(spark: SparkSession, source: str | Iterable[str]) -> DataFrame:
    """sent_id, text of a corpus: a file of one text per line or of a YAML list of plain or quoted scalars, or texts themselves.

    Ids count from 0 in the order of the texts. A file of lines is numbered in one pass over its partitions.
    """
    if not isinstance(source, str):
        return spark.createDataFrame(list(enumerate(source)), "sent_id long, text string")
    rows = spark.read.text(source).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    item = F.regexp_replace("line", r"^-\s+", "")
    plain = F.when(item.rlike(r'^".*"$'), F.replace(F.regexp_replace(item, r'^"|"$', ""), F.lit('\\"'), F.lit('"'))).when(item.rlike(r"^'.*'$"), F.replace(F.regexp_replace(item, r"^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(item)
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = rows.withColumn("part", part).join(F.broadcast(base), "part")
    return numbered.select((F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("sent_id"), plain.alias("text"))


def gazetteer(spark: SparkSession, path: str, source: str, typed: bool = True) -> DataFrame:
    """source, id, idx, t, type of a tab-separated file with a header; untyped files have no type column."""
    schema = GAZETTEER_SCHEMA if typed else GAZETTEER_SCHEMA.rpartition(",")[0]
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="")
    return rows.select(F.lit(source).alias("source"), "id", "idx", "t", (F.col("type") if typed else F.lit(None).cast("string")).alias("type"))


def assertion_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_name, raw_line of assertion dumps, plain or gzip; judged by `operators.malformed`, never dropped by the reader."""
    rows = spark.read.text(path)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("raw_line"))


def word_list(spark: SparkSession, path: str, *classes: str, rejected: DataFrame | None = None) -> DataFrame:
    """word, class of a file of one term per line, without those of `rejected` (word)."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    if rejected is not None:
        words = words.join(rejected.select("word").distinct(), "word", "left_anti")
    return words.select("word", F.explode(F.array(*map(F.lit, classes))).alias("class"))


def prepositions(spark: SparkSession, path: str) -> DataFrame:
    """name and flags of a JSON list; an entry that abbreviates or varies another takes over the flags that it lacks."""
    flags = ", ".join(f"{f} boolean" for f in PREPOSITION_FLAGS)
    rows = spark.read.json(path, schema=f"name string, alternativeOf string, abbreviationOf string, {flags}", multiLine=True)
    base = rows.select(F.col("name").alias("base"), *[F.col(f).alias(f"b_{f}") for f in PREPOSITION_FLAGS])
    met = rows.withColumn("base", F.coalesce("abbreviationOf", "alternativeOf")).join(base, "base", "left")
    return met.select("name", "base", *[F.coalesce(f, f"b_{f}", F.lit(False)).alias(f) for f in PREPOSITION_FLAGS])


def ordered_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule_order, construct, property, name, value, negated: one row per premise value of a JSON list of rules; the order is the place in the list."""
    one = "struct<construct: string, property: string, premises: map<string, array<string>>, not: map<string, array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<{one}>")).alias("rule_order", "r"))
    sides = [whole.select("rule_order", "r.construct", "r.property", F.explode(F.col("r")[k]).alias("name", "vs"), F.lit(k == "not").alias("negated")) for k in ("premises", "not")]
    return sides[0].unionByName(sides[1]).select("rule_order", "construct", "property", "name", F.explode("vs").alias("value"), "negated")


def graph_objects(spark: SparkSession, path: str) -> DataFrame:
    """sent_id and the graph's node columns of files `<sent_id>/result.json`, each a JSON list of objects."""
    number = F.regexp_extract(F.input_file_name(), r"/([0-9]+)/[^/]*$", 1).try_cast("long")
    rows = spark.read.text(path, wholetext=True).select(number.alias("sent_id"), F.from_json("value", f"array<struct<{GSM_SCHEMA}>>").alias("o"))
    return rows.select("sent_id", F.inline("o"))


def embeddings(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """term, vec of one language from a table of concept keys (term `/c/<lang>/<word>`, vec)."""
    rows = spark.read.parquet(path).where(F.col("term").startswith(f"/c/{lang}/"))
    return rows.select(F.element_at(F.split("term", "/"), 4).alias("term"), "vec")


def entailment_pairs(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n shortest pairs q, r, class of a parquet table, by their joint length, then text."""
    rows = spark.read.parquet(path)
    return rows.orderBy(F.length("q") + F.length("r"), "q", "r").limit(n)


def _term(text: Column) -> Column:
    literal = F.regexp_extract(text, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(F.replace(literal, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(text.startswith('"'), plain).otherwise(F.regexp_replace(text, "^<|>$", ""))


def triples(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """s, p, o, o_kind, o_type of a file with one triple per line: N-Triples, and Turtle written one triple per line with prefixed names and `a`.

    `prefixes` widens the prefixes that the file declares. Lines that are no triple are left out.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    declared = {r[0]: r[1] for r in lines.where(F.lower("v").startswith("@prefix")).select(F.regexp_extract("v", r"^@(?i:prefix)\s+([^:\s]*):", 1), F.regexp_extract("v", r"<([^>]*)>", 1)).limit(1000).collect()}
    known = declared | (prefixes or {})
    pattern = r'^(\S+)\s+(\S+)\s+("(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|\S+)\s*\.$'
    rows = lines.where(~F.col("v").startswith("@")).where(F.col("v").rlike(pattern)).select(*[F.regexp_extract("v", pattern, k).alias(c) for k, c in ((1, "s"), (2, "p"), (3, "o"))])
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else None

    def full(c: Column) -> Column:
        name = F.when(c == "a", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")).otherwise(_term(c))
        if table is None:
            return name
        head = F.regexp_extract(c, r"^([^:<\"]*):", 1)
        return F.when(~c.startswith("<") & ~c.startswith('"') & c.rlike(r"^[^:<\"]*:(?!//)") & ~c.startswith("_:"), F.coalesce(F.concat(F.try_element_at(table, head), F.regexp_replace(c, r"^[^:]*:", "")), c)).otherwise(name)

    kind = F.when(F.col("o").startswith('"'), "literal").when(F.col("o").startswith("_:"), "bnode").otherwise("iri")
    return rows.select(full(F.col("s")).alias("s"), full(F.col("p")).alias("p"), full(F.col("o")).alias("o"), kind.alias("o_kind"), F.nullif(F.regexp_replace(F.regexp_extract("o", r'"\^\^(\S+)$', 1), "^<|>$", ""), F.lit("")).alias("o_type"))
