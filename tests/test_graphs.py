import random

import pytest
from pyspark.sql import functions as F

from kernelweave.operators import graphs as G


def _edges(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def _closure(pairs):
    reach = {}
    for a, _ in pairs:
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for s, t in pairs:
                if s == x and t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach[a] = seen - {a}
    return {(a, b) for a, bs in reach.items() for b in bs}


@pytest.mark.parametrize("pairs", [[("A", "B"), ("B", "C")], [("A", "B"), ("B", "A"), ("A", "C"), ("C", "A")], [("A", "A")], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], []])
def test_closure_has_all_pairs_joined_by_a_path_and_no_loop(spark, pairs):
    got = {tuple(r) for r in G.transitive_closure(_edges(spark, [*pairs, ("x", None)])).collect()}
    assert got == _closure(pairs)


def test_components_agree_with_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 201 + k) for k in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {(x, find(x)) for a, b in pairs if a != b for x in (a, b)}
    assert {tuple(r) for r in G.connected_components(_edges(spark, pairs, "long")).collect()} == want


def test_levels_are_fewest_steps(spark):
    found = G.bfs_levels(_edges(spark, [("r", "a"), ("a", "b"), ("r", "b"), ("b", "r"), ("q", "z")]), spark.createDataFrame([("r",)], "node string"))
    assert {tuple(r) for r in found.collect()} == {("r", 0), ("a", 1), ("b", 1)}


def test_removed_nodes_are_bridged_through_chains(spark):
    edges = _edges(spark, [("a", "x"), ("x", "y"), ("y", "b"), ("x", "c"), ("y", "x"), ("b", "a"), ("x", "a")])
    gone = spark.createDataFrame([("x",), ("y",)], "node string")
    assert {tuple(r) for r in G.remove_nodes(edges, gone).collect()} == {("a", "b"), ("a", "c"), ("b", "a")}


def test_runs_cross_their_buckets(spark):
    values = "aaabbaacccccab" * 5
    rows = spark.createDataFrame([("u", k, v) for k, v in enumerate(values)] + [("w", 0, None), ("w", 1, None), ("w", 2, "a")], "user string, k int, v string")
    got = {(r.user, r.k): r.run for r in G.runs(rows, "user", ["k"], F.floor(F.col("k") / 4), "v").collect()}
    run, want = 0, {}
    for k, v in enumerate(values):
        run += k == 0 or v != values[k - 1]
        want["u", k] = run
    assert got == want | {("w", 0): 1, ("w", 1): 1, ("w", 2): 2}


def test_topological_order_leaves_out_what_is_on_or_after_a_cycle(spark):
    rows = [(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 4, 5), (1, 5, 4), (1, 5, 6), (1, 7, None)]
    found = G.group_order(spark.createDataFrame(rows, "g int, src long, dst long"), "g", G.topological("g"))
    assert {r.node: (r.rank, r.level) for r in found.collect()} == {1: (0, 0), 2: (1, 1), 3: (2, 2), 7: (3, 0), 4: (None, None), 5: (None, None), 6: (None, None)}
