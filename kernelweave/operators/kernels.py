"""Kernels of sentences from dependency-like graphs, and the atoms and formulae that they state.

Graph rewriting is one pass of joins over the links of all sentences at once: links of modifying kinds become
properties of their head, each verb is joined to its subject and object, several indirect objects become a
group, and coordinated members multiply a kernel into atoms under one connective. Arguments are chosen by
minimum (position, id), so no group is ever collected.

Defined results: a verb without subject gets an existential, numbered by position within its sentence; a verb
without object has none; an unnamed node is written `?`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODIFIERS = ("det", "amod", "case", "advmod", "compound", "appos", "nmod", "nmod:in", "nmod:of")
KEYS = {"case": "preposition", "det": "determiner", "amod": "quality", "advmod": "manner", "compound": "part", "appos": "alias", "nmod": "relation", "nmod:in": "SPACE", "nmod:of": "SPECIFICATION"}


def property_key(label: Column) -> Column:
    out = F.when(label == MODIFIERS[0], KEYS[MODIFIERS[0]])
    for m in MODIFIERS[1:]:
        out = out.when(label == m, KEYS[m])
    return out


def fold_modifiers(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties, links left): links of modifying kinds as head, key, value, member, ordinal; the others stay links."""
    is_modifier = F.col("label").isin(*MODIFIERS)
    named = nodes.select(F.col("id").alias("member"), F.coalesce("name", F.lit("?")).alias("value"), "pos")
    flat = links.where(is_modifier).select(F.col("src").alias("head"), property_key(F.col("label")).alias("key"), F.col("dst").alias("member")).distinct()
    order = Window.partitionBy("head", "key").orderBy("pos", "member")
    folded = flat.join(named, "member").select("head", "key", "value", "member", F.row_number().over(order).alias("ordinal"))
    return folded, links.where(~is_modifier | F.col("label").isNull())


def argument(nodes: DataFrame, links: DataFrame, label: str, name: str) -> DataFrame:
    """verb, <name>: the first child of a verb by one kind of link."""
    child = nodes.select(F.col("id").alias("dst"), "pos")
    met = links.where(F.col("label") == label).select("src", "dst").distinct().join(child, "dst")
    return met.groupBy(F.col("src").alias("verb")).agg(F.min(F.struct("pos", "dst")).alias("m")).select("verb", F.col("m.dst").alias(name))


def clauses(nodes: DataFrame, links: DataFrame, verb: str = "verb", subject: str = "nsubj", target: str = "dobj") -> DataFrame:
    """sent_id, verb, pos, rel, negated, src, dst (ids or null), existential (its number where there is no subject)."""
    verbs = nodes.where(F.col("kind") == verb).select("sent_id", F.col("id").alias("verb"), "pos", F.lower(F.coalesce("name", F.lit("?"))).alias("rel"))
    denied = links.where("label = 'neg'").select(F.col("src").alias("verb"), F.lit(True).alias("negated")).distinct()
    met = verbs.join(denied, "verb", "left").join(argument(nodes, links, subject, "src"), "verb", "left").join(argument(nodes, links, target, "dst"), "verb", "left")
    missing = F.col("src").isNull()
    number = F.row_number().over(Window.partitionBy("sent_id", missing).orderBy("pos", "verb"))
    return met.select("sent_id", "verb", "pos", "rel", F.coalesce("negated", F.lit(False)).alias("negated"), "src", "dst", F.when(missing, number).alias("existential"))


def mark_actions(kernels: DataFrame) -> DataFrame:
    """node, key, value: `action` on a subject and `actioned` on an object, the verb's relation as value; `root` on the verb."""
    side = lambda c, key: kernels.where(F.col(c).isNotNull()).select(F.col(c).alias("node"), F.lit(key).alias("key"), F.col("rel").alias("value"))
    return side("src", "action").unionByName(side("dst", "actioned")).unionByName(kernels.select(F.col("verb").alias("node"), F.lit("root").alias("key"), F.lit("true").alias("value"))).distinct()


def indirect_groups(nodes: DataFrame, links: DataFrame, label: str = "obl") -> DataFrame:
    """verb, member, ordinal, size of the indirect objects of verbs that have several."""
    child = nodes.select(F.col("id").alias("member"), "pos")
    flat = links.where(F.col("label") == label).select(F.col("src").alias("verb"), F.col("dst").alias("member")).distinct().join(child, "member")
    size = F.count(F.lit(1)).over(Window.partitionBy("verb"))
    numbered = flat.select("verb", "member", F.row_number().over(Window.partitionBy("verb").orderBy("pos", "member")).alias("ordinal"), size.alias("size"))
    return numbered.where("size > 1")


def _name(nodes: DataFrame, c: str, out: str) -> DataFrame:
    """Term of a node: lower case unless it is a place."""
    term = F.when(F.col("kind") == "GPE", F.col("name")).otherwise(F.lower("name"))
    return nodes.select(F.col("id").alias(c), F.coalesce(term, F.lit("?")).alias(out), F.col("kind").alias(f"{out}_kind"))


def named_kernels(kernels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Kernels with the terms of both ends: source (an existential where there is none) and target."""
    met = kernels.join(_name(nodes, "src", "s"), "src", "left").join(_name(nodes, "dst", "t"), "dst", "left")
    return met.withColumns({"source": F.coalesce("s", F.concat(F.lit("?"), F.col("existential").cast("string"))), "target": F.col("t")})


def kernel_text(kernels: DataFrame, properties: DataFrame) -> DataFrame:
    """verb, kernel: `rel(source, target)[(key:value), ...]`, in NOT(...) where negated; `kernels` are named, properties are those of the verb."""
    each = properties.select(F.col("head").alias("verb"), F.struct("key", "ordinal", F.concat_ws("", F.lit("("), "key", F.lit(":"), "value", F.lit(")")).alias("p")).alias("p"))
    held = each.groupBy("verb").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["p"]), ", ").alias("props"))
    body = F.concat(F.col("rel"), F.lit("("), F.concat_ws(", ", "source", "target"), F.lit(")"), F.when(F.col("props").isNotNull(), F.concat(F.lit("["), "props", F.lit("]"))).otherwise(""))
    return kernels.join(held, "verb", "left").select("verb", F.when(F.col("negated"), F.concat(F.lit("NOT("), body, F.lit(")"))).otherwise(body).alias("kernel"))


def distribute(kernels: DataFrame, nodes: DataFrame, links: DataFrame, connectors: DataFrame) -> DataFrame:
    """verb, connective, rel, source, target, source_kind, negated: one atom per coordinated member of the source.

    `connectors` has sent_id and connector; NEITHER is a conjunction of negations and turns a kernel's own negation round.
    """
    others = links.where("label = 'conj'").select("src", F.col("dst").alias("member")).distinct()
    one = kernels.select("sent_id", "verb", "rel", "negated", F.col("src").alias("member"), "dst", "existential")
    more = kernels.join(others, "src").select("sent_id", "verb", "rel", "negated", "member", "dst", "existential")
    every = one.unionByName(more).distinct()
    sized = every.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("verb"))).join(connectors, "sent_id", "left")
    named = named_kernels(sized.withColumnRenamed("member", "src"), nodes)
    kind = F.when(F.col("n") == 1, "ATOM").otherwise(F.when(F.col("connector") == "OR", "OR").otherwise("AND"))
    neither = (F.col("n") > 1) & F.coalesce(F.col("connector") == "NEITHER", F.lit(False))
    return named.select("sent_id", "verb", kind.alias("connective"), "rel", "source", "target", F.col("s_kind").alias("source_kind"), (F.col("negated") != neither).alias("negated"))


def normalise(atoms: DataFrame) -> DataFrame:
    """Atoms in normal form, with `form`, `arg`, `other`, `space` and their identity `fid`.

    A place that has something states that the something is, there: be(y)[SPACE: place]; a place alone is said to be;
    an atom without target is unary, with one binary. Equal atoms have one identity, whatever sentence states them.
    """
    place = F.col("source_kind").eqNullSafe("GPE")
    made = atoms.select(
        "sent_id", "verb", "connective", "negated",
        F.when(place | F.col("target").isNull(), "unary").otherwise("binary").alias("form"),
        F.when(place, "be").otherwise(F.col("rel")).alias("rel"),
        F.when(place, F.coalesce("target", F.col("rel"))).otherwise(F.col("source")).alias("arg"),
        F.when(~place, F.col("target")).alias("other"),
        F.when(place, F.col("source")).alias("space"),
    )
    canonical = F.concat_ws("|", "form", "rel", F.regexp_replace("arg", r"^\?[0-9]+$", "?"), F.coalesce("other", F.lit("-")), F.coalesce("space", F.lit("-")), F.col("negated").cast("string"))
    return made.withColumn("fid", F.md5(canonical))
