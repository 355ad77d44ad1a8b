import itertools

import pytest
from pyspark.sql import functions as F

from kernelweave.functions import text as T
from kernelweave.operators import verdicts as V
from kernelweave.operators import worlds as W


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()
    return row.v


@pytest.mark.parametrize(("a", "b", "edit", "cosine", "kernel"), [("mouse", "miuse", 0.8, 0.5, 2), ("", "", 1.0, 1.0, 0), ("a", "", 0.0, 0.0, 0), ("cat", "housecat", 0.375, 0.534522, 2), ("aaa", "aa", 2 / 3, 1.0, 1)])
def test_kernels_of_two_texts(spark, a, b, edit, cosine, kernel):
    x, y = F.col("a"), F.col("b")
    assert _one(spark, T.edit_similarity(x, y), a=a, b=b) == pytest.approx(edit)
    assert _one(spark, T.bigram_set_similarity(x, y), a=a, b=b) == pytest.approx(cosine, abs=1e-6)
    assert _one(spark, T.bigram_kernel(x, y), a=a, b=b) == kernel


def test_predicates_on_labels(spark):
    c = F.col("a")
    kinds = {"Neither a nor b": "NEITHER", "a or b and c": "OR", "a but b": "AND", "band order": "NONE"}
    assert {t: _one(spark, T.connector(c), a=t) for t in kinds} == kinds
    assert _one(spark, T.negated(c), a="does not go") and not _one(spark, T.negated(c), a="a note")
    assert _one(spark, T.erase_existentials(c), a="be(?12, x?)") == "be(?, x?)"
    assert _one(spark, T.innermost_brackets(c), a="a[b[c]d][e]") == ["c", "e"]
    assert _one(spark, T.chunks(F.split(c, " ")), a="a b c") == [["a", "b"], ["a", "b", "c"], ["b", "c"]]


def test_folds_of_verdicts(spark):
    fold = lambda f, *vs: spark.range(1).select(f(F.array(*map(F.lit, vs))).alias("v")).first().v
    assert fold(V.fold_any, "INDIFFERENT", "EQUIVALENT", "EXCLUSIVES") == "EXCLUSIVES"
    assert fold(V.fold_any, "GENERAL", "EQUIVALENT") == "EQUIVALENT" and fold(V.fold_any, "LOSE_SPEC", "INDIFFERENT") == "LOSE_SPEC"
    assert fold(V.fold_any, "LOSE_SPEC", "MISSING_1ST") == "GENERAL" and fold(V.fold_any, "INDIFFERENT") == "INDIFFERENT"
    assert fold(V.fold_all, "EQUIVALENT", "INDIFFERENT") == "INDIFFERENT" and fold(V.fold_all, "EQUIVALENT", "INSTANTIATION") == "INSTANTIATION"


def test_cat_and_mouse_matrix(spark):
    p, q = W.Atom("p"), W.Atom("q")
    got = {(r.i, r.j): r.verdict for r in W.score_formulae(spark, [p, p, q, q, W.Not(p), W.Not(q)], {}).collect()}
    same = [{0, 1}, {2, 3}, {4}, {5}]
    for i, j in itertools.product(range(6), range(6)):
        together = any({i, j} <= s for s in same)
        against = any(({i, j} & a) and ({i, j} & b) and i != j and i in a | b and j in a | b for a, b in ((same[0], same[2]), (same[1], same[3]))) and not together
        assert got[i, j] == ("Implying" if together else "Conflicting" if against else "Indifferent"), (i, j)


def test_closed_scores_agree_with_enumeration(spark):
    def holds(kind, bits):
        return {"AND": all(bits), "OR": any(bits), "NEITHER": not any(bits)}[kind]

    cases = []
    for ki, kj in itertools.product(("AND", "OR", "NEITHER"), repeat=2):
        for s, a, b in itertools.product(range(3), repeat=3):
            if s + a and s + b:
                worlds = [(holds(ki, w[: s + a]), holds(kj, w[:s] + w[s + a :])) for w in itertools.product((0, 1), repeat=s + a + b)]
                given = [y for x, y in worlds if x]
                cases.append((ki, kj, s, a, b, sum(given) / len(given)))
    rows = spark.createDataFrame(cases, "ki string, kj string, s int, a int, b int, want double")
    score = W.connective_scores(F.col("ki"), F.col("kj"), F.col("s"), F.col("a"), F.col("b"))
    assert rows.where(F.abs(score - F.col("want")) > 1e-9).count() == 0


def test_too_many_atoms_raise(spark):
    with pytest.raises(ValueError, match="atoms"):
        W.enumerate_worlds(spark, [W.Atom(f"x{k}") for k in range(21)], {})


def test_two_people_matrix(spark):
    from kernelweave.plans.reasoning import entailment_verdict

    want = ["1..10..0", ".1.1.0.0", "111100.0", "...1...0", "0.0.1...", ".00..1..", "......1.", "000011.1"]
    sign = {"Implying": "1", "Conflicting": "0", "Indifferent": "."}
    got = {(r.i, r.j): sign[r.verdict] for r in entailment_verdict(spark, "").collect()}
    assert ["".join(got[i, j] for j in range(8)) for i in range(8)] == want
