"""Expansion of atoms beside a brute-force fix-point, and what it writes to disk for a large class of equal names."""

import random
from collections import Counter
from pathlib import Path

import pytest

from kernelweave.operators import rules as U
from kernelweave.plans import reasoning as Q

NAMES = [("OppositeOf", "SameAs", True), ("HasPiece", "PartOf", False), ("NotSameAs", "IsA", True), ("IsA", "IsA", False)]


def _brute(edges, names):
    """Members (p, o, negated) by atom (origin, p, s, o): one rewriting at a time."""
    ends = lambda p: {(s, o) for _, q, s, o in edges if q == p and s != o}
    equal, other = ends("SameAs") | {(b, a) for a, b in ends("SameAs")}, ends("OppositeOf")
    origin = {}
    for i, p, s, o in edges:
        origin[p, s, o] = min(i, origin.get((p, s, o), i))
    made = {}
    for p, o in {(p, o) for p, _, o in origin}:
        seen, new = {(p, o, False)}, [(p, o, False)]
        while new:
            q, x, no = new.pop()
            found = {(q, b, no) for a, b in equal if a == x} | {(r, x, no != flips) for n, r, flips in names if n == q != r}
            if not no:
                found |= {(q, b, True) for a, b in other if a == x}
            new += found - seen
            seen |= found
        made[p, o] = seen
    return {(i, *k): made[k[0], k[2]] for k, i in origin.items()}


def _rows(made):
    return [(i, p, s, o, no) for (i, _, s, _), found in made.items() for p, o, no in found]


def _verdicts(made):
    own, test = {(p, s, o): i for i, p, s, o in made}, {}
    for i, p, s, o, no in _rows(made):
        x = own.get((p, s, o), i)
        for pair, n in [((x, i), 1 if no else 2), ((i, x), 1)][: 1 + no]:
            if x != i:
                test[pair] = min(n, test.get(pair, n))
    return Counter((*k, "EXCLUSIVES" if n == 1 else "GENERAL") for k, n in test.items())


def _counts(made):
    hold, deny = (Counter((p, s, o) for _, p, s, o, no in _rows(made) if no == side) for side in (False, True))
    return Counter((*k, hold[k], deny[k]) for k in hold | deny)


def _stored(spark, d, edges, names):
    spark.createDataFrame([(i, f"/r/{p}", s, o) for i, p, s, o in edges], "edge_id long, relation_id string, start_id string, end_id string").write.parquet(f"{d}/conceptnet_edge.parquet")
    spark.createDataFrame(names, "label string, rel string, rel_negated boolean").write.parquet(f"{d}/relation_map.parquet")
    return str(d)


def _written(spark) -> int:
    """Bytes of all shuffles and checkpoints of the session so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    kept = Path((spark.sparkContext.getCheckpointDir() or "file:/none").removeprefix("file:"))
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite() + sum(f.stat().st_size for f in kept.rglob("*") if f.is_file())


@pytest.fixture(scope="module")
def large_class(spark, tmp_path_factory):
    """1,200 atoms on one class of 400 names, of which a few have an opposite, and what they make."""
    edges = [(k, "SameAs", f"/c/en/name_{k}", "/c/en/hub") for k in range(1, 400)]
    edges += [(400 + k, ("IsA", "PartOf", "NotSameAs")[k % 3], f"/c/en/subject_{k // 2}", f"/c/en/name_{1 + k % 399}") for k in range(800)]
    edges += [(1200 + k, "OppositeOf", f"/c/en/name_{1 + k}", f"/c/en/other_{k}") for k in range(3)]
    return _stored(spark, tmp_path_factory.mktemp("large"), edges, NAMES), _brute(edges, NAMES)


def _few_bytes(spark, query, d, members):
    before = _written(spark)
    rows = [tuple(r) for r in query(spark, d).collect()]
    assert _written(spark) - before < 8 * members
    return rows


def test_fixpoint_of_a_large_class_is_not_stored(spark, large_class):
    d, made = large_class
    rows = _few_bytes(spark, Q.rule_fixpoint, d, sum(map(len, made.values())))
    assert Counter(rows) == Counter(_rows(made))


def test_comparison_over_a_large_class_lists_no_expansions(spark, large_class):
    d, made = large_class
    rows = _few_bytes(spark, Q.expansion_compare, d, sum(map(len, made.values())))
    assert Counter(rows) == _verdicts(made)


def test_members_of_a_large_class_are_not_stored(spark, large_class):
    d, made = large_class
    rows = _few_bytes(spark, Q.expansion_members, d, sum(map(len, made.values())))
    assert Counter(rows) == _counts(made)


@pytest.mark.parametrize("seed", range(3))
def test_expansion_is_that_of_single_rewritings(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(U, "SLICE", 2)
    pick = random.Random(seed)
    kinds = ["SameAs"] * 3 + ["OppositeOf"] * 2 + ["HasPiece", "NotSameAs", "IsA", "PartOf", "Wants"]
    edges = [(k, pick.choice(kinds), f"n{pick.randrange(12)}", f"n{pick.randrange(24)}") for k in range(90)]
    names = [*NAMES, ("IsA", "NotSameAs", True), ("PartOf", "Wants", True), ("Wants", "HasPiece", False)] if seed else NAMES
    made, d = _brute(edges, names), _stored(spark, tmp_path, edges, names)
    assert Counter(map(tuple, Q.rule_fixpoint(spark, d).collect())) == Counter(_rows(made))
    assert Counter(map(tuple, Q.expansion_compare(spark, d).collect())) == _verdicts(made)
    assert Counter(map(tuple, Q.expansion_members(spark, d).collect())) == _counts(made)
