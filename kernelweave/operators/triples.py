"""Triple patterns over a table of s, p, o.

A pattern is a triple of texts in which `?x` names a variable. Constants become filters that reach the
scan, patterns are joined on the variables that they share, optional groups are outer joins, and a union
aligns its branches on their variables. Results hold one column per variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.runtime import cut

Pattern = tuple[str, str, str]


def match(store: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern; a variable that occurs twice must be bound to one value."""
    rows, names = store, {}
    for column, term in zip("spo", pattern, strict=True):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term in names:
            rows = rows.where(F.col(column) == F.col(names[term]))
        else:
            names[term] = column
    return rows.select(*[F.col(c).alias(v[1:]) for v, c in names.items()])


def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError(f"patterns share no variable: {left.columns} and {right.columns}")
    return left.join(right, shared, how)


def bgp(store: DataFrame, patterns: list[Pattern], optional: list[list[Pattern]] = (), negative: list[list[Pattern]] = ()) -> DataFrame:
    """Distinct bindings of all patterns, widened by every optional group and without those that a negative group binds."""
    found = reduce(lambda a, b: _join(a, b, "inner"), [match(store, p) for p in patterns])
    for group in optional:
        found = _join(found, bgp(store, list(group)), "left")
    for group in negative:
        found = _join(found, bgp(store, list(group)), "left_anti")
    return found.distinct()


def union(*branches: DataFrame) -> DataFrame:
    """Distinct union; variables that a branch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches).distinct()


def pivot(store: DataFrame, predicates: list[str], must: str) -> DataFrame:
    """s, and for every predicate the smallest object and the number of distinct ones, of the subjects that have `must`.

    The optional patterns of a catalogue in one aggregation: no join, and a hot subject is aggregated on the map side.
    """
    cells = store.where(F.col("p").isin(predicates)).groupBy("s", "p", "o").agg(F.lit(1).alias("one"))
    name = lambda p: p.lower()
    columns = [e for p in predicates for e in (F.min(F.when(F.col("p") == p, F.col("o"))).alias(name(p)), F.count(F.when(F.col("p") == p, 1)).alias(f"n_{name(p)}"))]
    return cells.groupBy("s").agg(*columns).where(F.col(f"n_{name(must)}") > 0)


def neighbours(store: DataFrame, predicate: str, outgoing: bool = True) -> DataFrame:
    """Distinct node, label, neighbour of one predicate, along or against the edge."""
    ends = ("s", "o") if outgoing else ("o", "s")
    return store.where(F.col("p") == predicate).select(F.col(ends[0]).alias("node"), F.col("p").alias("label"), F.col(ends[1]).alias("neighbour")).distinct()


def super_types(instance_of: DataFrame, subclass_of: DataFrame) -> DataFrame:
    """node, type, steps: every class of a node, directly or by the classes above, with the fewest steps.

    `instance_of` has node and type, `subclass_of` has type and above. Classes are closed first, among
    themselves; the many instances are joined once.
    """
    up = cut(subclass_of.select("type", "above").where("type <> above").distinct())
    known = front = cut(up.select("type", "above", F.lit(1).alias("steps")))
    while front.limit(1).count():
        ahead = front.join(up.select(F.col("type").alias("above"), F.col("above").alias("far")), "above").select("type", F.col("far").alias("above"), (F.col("steps") + 1).alias("steps")).distinct()
        front = cut(ahead.join(known, ["type", "above"], "left_anti"))
        known = cut(known.unionByName(front))
    own = instance_of.select("node", "type").distinct()
    above = own.join(known, "type").select("node", F.col("above").alias("type"), "steps")
    return own.withColumn("steps", F.lit(0)).unionByName(above).groupBy("node", "type").agg(F.min("steps").alias("steps"))
