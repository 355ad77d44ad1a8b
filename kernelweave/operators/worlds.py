"""Possible worlds of formulae, and how far one formula entails another.

`score_formulae` enumerates worlds as bit masks and keeps those that the constraints between atoms allow; the
number of atoms is checked, beyond the bound it raises. `connective_scores` needs no enumeration: for AND, OR
and NEITHER over independent atoms the share of the premise's worlds in which the conclusion holds depends only
on how many atoms are shared and how many each side has alone, so formulae of any size cost the same.

Defined results: the score is the mean of the conclusion over the worlds where the premise holds, 0 if
there is none; 1 is Implying, 0 Conflicting, all else Indifferent.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.operators.verdicts import CONSTRAINTS

MOST_ATOMS = 20


@dataclass(frozen=True)
class Atom:
    name: str


@dataclass(frozen=True)
class Not:
    arg: Formula


@dataclass(frozen=True)
class And:
    args: tuple[Formula, ...]


@dataclass(frozen=True)
class Or:
    args: tuple[Formula, ...]


Formula = Atom | Not | And | Or


def atoms_of(f: Formula) -> set[Formula]:
    """Atoms; a negated formula that is no connective of others counts as an atom of its own."""
    if isinstance(f, Atom):
        return {f}
    if isinstance(f, Not):
        return {f} if isinstance(f.arg, Atom) else atoms_of(f.arg)
    return set().union(*map(atoms_of, f.args)) if f.args else set()


def valuation(f: Formula, bit: dict[Formula, Column]) -> Column:
    """0 or 1: And is the least, Or the greatest, Not its atom or 1 less its argument."""
    if f in bit:
        return bit[f]
    if isinstance(f, Not):
        return F.lit(1) - valuation(f.arg, bit)
    if not f.args:
        return F.lit(1 if isinstance(f, And) else 0)
    values = [valuation(x, bit) for x in f.args]
    return values[0] if len(values) == 1 else (F.least if isinstance(f, And) else F.greatest)(*values)


def _show(f: Formula) -> str:
    return f.name if isinstance(f, Atom) else f"not_{_show(f.arg)}" if isinstance(f, Not) else "".join(map(_show, f.args))


def enumerate_worlds(spark: SparkSession, atoms: list[Formula], verdicts: dict[tuple[Formula, Formula], str]) -> DataFrame:
    """world and one 0/1 column per atom, of the worlds that satisfy the verdicts between atoms.

    An atom and its negation conflict without being told.
    """
    if len(atoms) > MOST_ATOMS:
        raise ValueError(f"{len(atoms)} atoms are beyond {MOST_ATOMS}; split independent groups first")
    bit = {a: F.shiftright("world", k).bitwiseAND(F.lit(1)).cast("int") for k, a in enumerate(atoms)}
    told = dict(verdicts) | {(a, Not(a)): "Conflicting" for a in atoms if Not(a) in bit}
    allowed = [reduce(lambda x, y: x | y, [(bit[a] == p) & (bit[b] == q) for p, q in CONSTRAINTS[v]]) for (a, b), v in told.items()]
    worlds = spark.range(1 << len(atoms)).withColumnRenamed("id", "world")
    kept = worlds.where(reduce(lambda x, y: x & y, allowed)) if allowed else worlds
    return kept.select("world", *[bit[a].alias(_show(a)) for a in atoms])


def verdict(score: Column) -> Column:
    return F.when(score == 1, "Implying").when(score == 0, "Conflicting").otherwise("Indifferent")


def score_formulae(spark: SparkSession, formulae: list[Formula], verdicts: dict[tuple[Formula, Formula], str]) -> DataFrame:
    """i, j, score, verdict of every ordered pair of `formulae`."""
    atoms = sorted(set().union(*map(atoms_of, formulae)), key=_show)
    worlds = enumerate_worlds(spark, atoms, verdicts)
    bit = {a: F.col(_show(a)) for a in atoms}
    held = F.array_compact(F.array(*[F.when(valuation(f, bit) == 1, F.lit(k)) for k, f in enumerate(formulae)]))
    true = worlds.select(held.alias("held"))
    premise = true.select(F.explode("held").alias("i"), "held")
    total = premise.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    both = premise.select("i", F.explode("held").alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
    cells = spark.createDataFrame([(i, j) for i in range(len(formulae)) for j in range(len(formulae))], "i int, j int")
    met = cells.join(F.broadcast(total), "i", "left").join(F.broadcast(both), ["i", "j"], "left")
    score = F.coalesce(F.col("c") / F.col("n"), F.lit(0.0))
    return met.select("i", "j", score.alias("score"), verdict(score).alias("verdict"))


def connective_scores(kind_i: Column, kind_j: Column, shared: Column, only_i: Column, only_j: Column) -> Column:
    """Score of formula i towards j, both AND, OR or NEITHER over distinct independent atoms, from the counts of their atoms."""
    two = lambda n: F.pow(F.lit(2.0), n)
    rest = 1 / two(only_j)
    none_shared = shared == 0
    n_i = two(shared + only_i) - 1
    off = (two(only_i) - 1) / n_i * rest
    on = F.when(none_shared, rest).otherwise(two(only_i) / n_i * rest)
    given_and = F.when(kind_j == "AND", rest).when(kind_j == "OR", F.when(none_shared, 1 - rest).otherwise(1.0)).otherwise(F.when(none_shared, rest).otherwise(0.0))
    given_no = F.when(kind_j == "NEITHER", rest).when(kind_j == "OR", 1 - rest).otherwise(F.when(none_shared, rest).otherwise(0.0))
    given_or = F.when(kind_j == "AND", on).when(kind_j == "OR", 1 - off).otherwise(off)
    return F.when(kind_i == "AND", given_and).when(kind_i == "NEITHER", given_no).otherwise(given_or)
