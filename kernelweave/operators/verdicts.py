"""Verdicts on names, terms and properties.

Names are compared by joins over the distinct pairs that are asked: a pair's shared types are looked up from the
side with fewer types, so a name with very many never multiplies its pairs. Terms are compared by one
expression over joined verdicts.

Fine verdicts: EQUIVALENT, EXCLUSIVES, INDIFFERENT and the implications GENERAL, LOSE_SPEC, INSTANTIATION, MISSING_1ST.
Defined results: two absent names are equivalent; an absent left name is missing, an absent right one indifferent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPLICATIONS = ("GENERAL", "LOSE_SPEC", "INSTANTIATION", "MISSING_1ST")
EQ, EX, IN, GE = "EQUIVALENT", "EXCLUSIVES", "INDIFFERENT", "GENERAL"


def implies(verdict: Column) -> Column:
    return verdict.isin(*IMPLICATIONS)


def flip_negated(verdict: Column) -> Column:
    """Verdict when one of both sides is negated: equivalence and exclusion are exchanged, the rest is indifferent."""
    return F.when(verdict == EQ, EX).when(verdict == EX, EQ).otherwise(IN)


def coarse(verdict: Column) -> Column:
    """Fine verdict as Equivalent, Conflicting, Implying or Indifferent."""
    return F.when(verdict == EQ, "Equivalent").when(verdict == EX, "Conflicting").when(implies(verdict), "Implying").otherwise("Indifferent")


def _implied(kinds: Column) -> Column:
    held = F.array_intersect(kinds, F.array(*map(F.lit, IMPLICATIONS)))
    return F.when(F.size(held) == 1, F.get(held, F.lit(0))).when(F.size(held) > 1, F.lit(GE))


def fold_any(kinds: Column) -> Column:
    """One verdict for the values of one key: exclusion, else equivalence, else the implication (GENERAL if several kinds)."""
    has = lambda v: F.array_contains(kinds, v)
    return F.when(has(EX), EX).when(has(EQ), EQ).otherwise(F.coalesce(_implied(kinds), F.lit(IN)))


def fold_all(kinds: Column) -> Column:
    """One verdict across keys: indifference, else exclusion, else the implication, else equivalence."""
    has = lambda v: F.array_contains(kinds, v)
    return F.when(has(IN), IN).when(has(EX), EX).otherwise(F.coalesce(_implied(kinds), F.when(has(EQ), EQ), F.lit(IN)))


def is_existential(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^\?[0-9]+$"), F.lit(False))


def name_verdicts(pairs: DataFrame, types: DataFrame, same: DataFrame, unlike: DataFrame, above: DataFrame) -> DataFrame:
    """a, b, verdict of the distinct `pairs` (a, b).

    `types` (name, type), `same` (a, b; in both directions), `unlike` (a, b) and `above` (a, b: a lies below b) are
    distinct. Names must share a type to be compared; then exclusion, equivalence and hierarchy are tried in turn.
    """
    asked = pairs.select("a", "b").distinct()
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    quick = (
        F.when(F.col("a").eqNullSafe(F.col("b")) | (absent("a") & absent("b")), EQ).when(absent("a"), "MISSING_1ST").when(absent("b"), IN).when(is_existential(F.col("a")) | is_existential(F.col("b")), EQ)
    )
    judged = asked.withColumn("quick", quick)
    open_pairs = judged.where("quick IS NULL").select("a", "b")
    n = types.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    sized = open_pairs.join(n.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    few, many = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a"))
    sided = sized.select("a", "b", few.alias("few"), many.alias("name")).join(types.select(F.col("name").alias("few"), "type"), "few")
    shared = sided.join(types, ["name", "type"], "left_semi").select("a", "b").distinct()

    def flag(met: DataFrame, name: str) -> DataFrame:
        return met.select("a", "b").distinct().withColumn(name, F.lit(True))

    syn = same.select(F.col("a").alias("x"), F.col("b").alias("y"))
    alike = flag(shared.join(same, ["a", "b"], "left_semi"), "alike")
    left = shared.join(syn.select(F.col("x").alias("a"), F.col("y").alias("a2")), "a")
    both = flag(left.join(syn.select(F.col("x").alias("b"), F.col("y").alias("a2")), ["b", "a2"], "left_semi"), "both")
    under = shared.select("a", "b", F.col("a").alias("a2")).unionByName(left.select("a", "b", "a2"))
    sides = under.select("a", "b", "a2", F.col("b").alias("b2")).unionByName(under.join(syn.select(F.col("x").alias("b"), F.col("y").alias("b2")), "b").select("a", "b", "a2", "b2"))
    lower = flag(sides.join(above.select(F.col("a").alias("a2"), F.col("b").alias("b2")), ["a2", "b2"], "left_semi"), "lower")
    out = judged.join(flag(shared, "shared"), ["a", "b"], "left")
    for extra in (flag(shared.join(unlike, ["a", "b"], "left_semi"), "unlike"), alike, both, lower):
        out = out.join(extra, ["a", "b"], "left")
    verdict = F.coalesce("quick", F.when(F.col("shared"), F.when(F.col("unlike"), EX).when(F.col("alike") | F.col("both"), EQ).when(F.col("lower"), GE)), F.lit(IN))
    return out.select("a", "b", verdict.alias("verdict"))


def term_verdict(v: dict[str, Column], lhs: Column, rhs: Column) -> Column:
    """Verdict on two terms, structs of name, spec, cop, as_all, spec_negation.

    `v` holds the verdicts on names: name (left, right), flip (right, left), spec, spec_inv, cop_inv (right, left),
    and name_in_spec (left name, right specification), spec_in_name (right name, left specification).
    """
    l_all, r_all = lhs["as_all"], rhs["as_all"]
    name, cop = v["name"], v["cop_inv"]
    spec = F.when(lhs["spec_negation"] != rhs["spec_negation"], flip_negated(v["spec"])).otherwise(v["spec"])
    as_spec = (v["spec_in_name"] == EQ) & rhs["name"].isNotNull() & lhs["spec"].isNotNull()
    in_spec = (v["name_in_spec"] == EQ) & lhs["name"].isNotNull() & rhs["spec"].isNotNull()
    instance = F.lit("INSTANTIATION")
    other_name = (
        F.when(l_all & r_all, F.when(in_spec, instance))
        .when(l_all, F.when(as_spec, instance).when(implies(v["flip"]), v["flip"]))
        .when(~r_all, F.when(as_spec, instance))
    )
    same_name = (
        F.when(spec == cop, F.when(((l_all == r_all) | l_all) & ~implies(spec), spec))
        .when(spec == EQ, F.when(cop == "MISSING_1ST", "LOSE_SPEC").otherwise(cop))
        .when(spec == "MISSING_1ST", F.when(l_all, instance))
        .otherwise(F.when(r_all | rhs["spec"].isNotNull(), spec).otherwise(v["spec_inv"]))
    )
    lower_name = (
        F.when((spec == EQ) & (cop == EQ), F.when(l_all & ~r_all, name))
        .when((spec == EQ) & (cop == EX), EX)
        .when(lhs["spec"].isNull() & (v["name_in_spec"] == EQ), F.when(l_all, instance))
    )
    apart = F.when((spec == EQ) & (cop == EQ), EX)
    whole = F.when((name == spec) & (spec == cop) & (l_all == r_all), spec)
    by_name = F.when(name == IN, other_name).when(name == EQ, same_name).when(implies(name), lower_name).when(name == EX, apart)
    return F.when(lhs.eqNullSafe(rhs), EQ).otherwise(F.coalesce(whole, by_name, F.lit(IN)))


CONSTRAINTS = {"Indifferent": ((0, 0), (0, 1), (1, 0), (1, 1)), "Implying": ((0, 0), (0, 1), (1, 1)), "Conflicting": ((0, 1), (1, 0)), "Equivalent": ((0, 0), (1, 1))}
