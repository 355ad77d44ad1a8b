"""Ordered rules over features, and expansion of atoms by equivalences to a fix-point.

A rule asks that, for each of its names, one of the listed values is among the node's values; excluded names
must have none. Rules are few, so they are compiled into one `CASE` over feature columns: no join and no
shuffle. Expansion runs over pairs of relation and class of equal objects instead of atoms: a round rewrites
only the pairs that the round before found, and atoms and members are joined to them at the end, so what is
stored does not grow with the product of a class's atoms and its members.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelweave.operators import graphs as G
from kernelweave.runtime import broadcast_if_small, cut

#: A join's key is cut into a slice for so many of its rows.
SLICE = 256


@dataclass(frozen=True)
class Rule:
    """One rule: what it makes of a node for which all premises and no exclusions hold."""

    order: int
    result: str
    premises: Mapping[str, Sequence[str]] = field(default_factory=dict)
    excluded: Mapping[str, Sequence[str]] = field(default_factory=dict)


def _holds(features: Mapping[str, Column], name: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.array_compact(features[name]), F.array(*map(F.lit, values))), F.lit(False))


def condition(rule: Rule, features: Mapping[str, Column]) -> Column:
    """Whether a rule matches; features are arrays of texts, null as empty."""
    must = [_holds(features, n, v) for n, v in rule.premises.items()]
    must += [~_holds(features, n, v) for n, v in rule.excluded.items()]
    return reduce(lambda a, b: a & b, must, F.lit(True))


def first_match(rules: Sequence[Rule], features: Mapping[str, Column]) -> Column:
    """struct(order, result) of the first rule, by order, that matches; null where none does."""
    cases = sorted(rules, key=lambda r: r.order)
    made = lambda r: F.struct(F.lit(r.order).alias("order"), F.lit(r.result).alias("result"))
    out = F.when(condition(cases[0], features), made(cases[0]))
    for rule in cases[1:]:
        out = out.when(condition(rule, features), made(rule))
    return out


def all_matches(rules: Sequence[Rule], features: Mapping[str, Column]) -> Column:
    """Array of the orders of all rules that match."""
    return F.array_compact(F.array(*[F.when(condition(r, features), F.lit(r.order)) for r in sorted(rules, key=lambda r: r.order)]))


@dataclass(frozen=True)
class Expansion:
    """What every atom can be rewritten to, by classes of equal objects; nothing here is as long as the atoms times what they reach.

    rows: origin, p0, s, c0 of every atom, c0 the class of its object. members: c, o of classes of several objects.
    reach: p0, c0, p, c, negated of every pair of relation and class that can change or has equals, itself
    included. names: p, q, flips. busy (p0, c0, k) and large (c, k): keys of many atoms, classes of many members,
    and into how many slices their joins are cut.
    """

    rows: DataFrame
    members: DataFrame
    reach: DataFrame
    names: DataFrame
    busy: DataFrame
    large: DataFrame


def expansion(atoms: DataFrame, same: DataFrame, unlike: DataFrame, renamed: DataFrame, most_rounds: int = 1000) -> Expansion:
    """Classes of equal objects, and what relations and classes of `atoms` (origin, p, s, o) lead to.

    `same` (a, b), read in both directions, rewrites an object to its equals, `unlike` (a, b) to what it is not,
    with negation, and `renamed` (p, q, flips) a relation to another, with negation where flips. Only atoms that
    hold are rewritten by `unlike`. More rounds of renaming and `unlike` than `most_rounds` raise.
    """
    classes = cut(G.connected_components(same.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("o"), F.col("component").alias("c")))
    members = classes.select("c", "o")

    def classed(df: DataFrame, name: str, to: str) -> DataFrame:
        return df.join(classes.select(F.col("o").alias(name), "c"), name, "left").withColumn(to, F.coalesce("c", name)).drop("c")

    other = cut(classed(classed(unlike.select("a", "b").where("a <> b").distinct(), "a", "x"), "b", "y").select("x", "y").distinct())
    names = cut(renamed.select("p", "q", "flips").where("p <> q").distinct())
    rows = classed(atoms.select("origin", F.col("p").alias("p0"), "s", "o").distinct(), "o", "c0").select("origin", "p0", "s", "c0")
    starts = cut(rows.groupBy("p0", "c0").agg(F.count(F.lit(1)).alias("n")))
    moved = members.select(F.col("c").alias("c0")).unionByName(other.select(F.col("x").alias("c0"))).distinct().withColumn("m", F.lit(True))
    told = names.select(F.col("p").alias("p0")).distinct().withColumn("t", F.lit(True))
    live = starts.join(moved, "c0", "left").join(F.broadcast(told), "p0", "left").where("m OR t")
    key = ["p0", "c0", "p", "c", "negated"]
    known = front = cut(live.select("p0", "c0", F.col("p0").alias("p"), F.col("c0").alias("c"), F.lit(False).alias("negated")))
    for _ in range(most_rounds):
        if not front.limit(1).count():
            break
        by_other = front.where("NOT negated").join(other, F.col("c") == F.col("x")).select("p0", "c0", "p", F.col("y").alias("c"), F.lit(True).alias("negated"))
        by_name = front.join(F.broadcast(names), "p").select("p0", "c0", F.col("q").alias("p"), "c", (F.col("negated") != F.col("flips")).alias("negated"))
        front = cut(by_other.unionByName(by_name).distinct().join(known, key, "left_anti"))
        known = cut(known.unionByName(front))
    else:
        raise RuntimeError(f"no fix-point after {most_rounds} rounds")
    slices = F.ceil(F.col("n") / SLICE).alias("k")
    busy = broadcast_if_small(starts.where(F.col("n") > SLICE).select("p0", "c0", slices))
    large = broadcast_if_small(members.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE).select("c", slices))
    return Expansion(rows, members, known, names, busy, large)


def _sliced(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, by: Column) -> DataFrame:
    """Left join; of a key in `hot` (with k), left rows are dealt over k slices by `by` and right rows repeated for each, so no task has all its pairs."""
    k = F.coalesce("k", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("slice", F.pmod(by, k)).drop("k")
    repeated = right.join(hot, on, "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), k - 1))).drop("k")
    return dealt.join(repeated, [*on, "slice"], "left").drop("slice")


def _with_members(classes: DataFrame, e: Expansion, by: Column) -> DataFrame:
    """Rows of classes (c) as rows of their members (o)."""
    return _sliced(classes, e.members, ["c"], e.large, by).withColumn("o", F.coalesce("o", "c")).drop("c")


def _spread(rows: DataFrame, reached: DataFrame, e: Expansion, by: Column) -> DataFrame:
    """`rows` (p0, c0) with p and o of all that they reach; what comes out is never shuffled, only one list a key."""
    full = _with_members(reached, e, F.xxhash64("p0", "c0"))
    return _sliced(rows, full, ["p0", "c0"], e.busy, by).withColumn("p", F.coalesce("p", "p0")).withColumn("o", F.coalesce("o", "c0"))


def expand_atoms(e: Expansion) -> DataFrame:
    """origin, p, s, o, negated: every atom with all that it can be rewritten to."""
    return _spread(e.rows, e.reach, e, F.xxhash64("origin")).select("origin", "p", "s", "o", F.coalesce("negated", F.lit(False)).alias("negated"))


def compare_expansions(e: Expansion) -> DataFrame:
    """x, y, verdict of every pair of atoms where the original of x or its negation is among the expansion of y, or the negation of y's original is among x's.

    Tests in order: the negation of one original among the other's expansion excludes; x's original among y's
    expansion is implied. An expansion keeps its atom's subject, so pairs are atoms of one subject whose relations
    lead to each other, looked up among what relations and classes reach.
    """
    follows = G.transitive_closure(e.names.select(F.col("p").alias("src"), F.col("q").alias("dst"))).select(F.col("src").alias("p0"), F.col("dst").alias("p"))
    left = e.rows.join(e.reach.select("p0", "c0").distinct(), ["p0", "c0"], "left_semi").select(F.col("origin").alias("y"), "p0", "c0", "s")
    asked = left.withColumn("p", F.col("p0")).unionByName(left.join(F.broadcast(follows), "p0"))
    own = e.rows.select(F.col("origin").alias("x"), F.col("p0").alias("p"), F.col("c0").alias("c"), "s")
    found = asked.join(own, ["s", "p"]).where("x <> y").join(e.reach, ["p0", "c0", "p", "c"])
    test = lambda x, y, n: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(n).alias("test"))
    met = found.select(F.explode(F.when(F.col("negated"), F.array(test("x", "y", 1), test("y", "x", 1))).otherwise(F.array(test("x", "y", 2)))).alias("t")).select("t.*")
    return met.groupBy("x", "y").agg(F.min("test").alias("test")).select("x", "y", F.when(F.col("test") == 1, "EXCLUSIVES").otherwise("GENERAL").alias("verdict"))


def shared_members(e: Expansion) -> DataFrame:
    """p, s, o, n_hold, n_deny: how many atoms expand to a member and how many to its negation; no pairs of atoms are formed.

    Atoms of one subject share members only where renaming connects their relations: what no other atom of its
    subject can meet is listed as it is, the rest is summed by class before classes become members.
    """
    kin = G.connected_components(e.names.select(F.col("p").alias("src"), F.col("q").alias("dst"))).select(F.col("node").alias("p0"), F.col("component").alias("kin"))
    groups = e.rows.groupBy("s", "p0", "c0").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(kin), "p0", "left").withColumn("kin", F.coalesce("kin", "p0"))
    crowds = groups.groupBy("s", "kin").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("s", "kin", F.lit(True).alias("crowd"))
    groups = cut(groups.join(crowds, ["s", "kin"], "left").select("s", "p0", "c0", "n", "crowd"))
    counts = e.reach.groupBy("p0", "c0", "p", "c").agg(F.max((~F.col("negated")).cast("int")).alias("hold"), F.max(F.col("negated").cast("int")).alias("deny"))
    hold, deny = (F.col("n") * F.coalesce("hold", F.lit(1))).alias("n_hold"), (F.col("n") * F.coalesce("deny", F.lit(0))).alias("n_deny")
    alone = _spread(groups.where("crowd IS NULL"), counts, e, F.xxhash64("s")).select("p", "s", "o", hold, deny)
    classes = groups.where("crowd").join(counts, ["p0", "c0"], "left").select(F.coalesce("p", "p0").alias("p"), "s", F.coalesce("c", "c0").alias("c"), hold, deny)
    summed = classes.groupBy("p", "s", "c").agg(F.sum("n_hold").alias("n_hold"), F.sum("n_deny").alias("n_deny"))
    return alone.unionByName(_with_members(summed, e, F.xxhash64("p", "s")).select("p", "s", "o", "n_hold", "n_deny"))
