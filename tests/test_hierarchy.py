import random

from kernelweave.operators.hierarchy import descendant_rows, dropped_links, resolve_hierarchy


def _resolve(spark, nodes, pairs):
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    return resolve_hierarchy(ids, spark.createDataFrame(pairs, "parent long, child long"), intervals=True)


def _brute(nodes, pairs):
    up = {}
    for p, c in sorted(pairs, reverse=True):
        if p in nodes and c in nodes:
            up[c] = p
    out = {}
    for n in nodes:
        path, x = [n], n
        while x in up and up[x] not in path:
            x = up[x]
            path.append(x)
        if x in up:
            ring, y = {up[x]}, up[up[x]]
            while y not in ring:
                ring.add(y)
                y = up[y]
            out[n] = (-1, -1, "", "on_cycle" if n in ring else "under_cycle")
        else:
            out[n] = (x, len(path) - 1, "/".join(map(str, reversed(path))), "tree")
    return out


def test_random_forests_with_cycles_agree_with_brute_force(spark):
    rng = random.Random(5)
    nodes = list(range(1, 61))
    pairs = [(rng.choice(nodes), n) for n in nodes if rng.random() < 0.9] + [(7, 7), (99, 3), (4, 98)]
    found = _resolve(spark, [*nodes, 5], pairs).collect()
    want = _brute(set(nodes), pairs)
    assert {r.node_id: (r.root_id, r.depth, r.path, r.status) for r in found} == want


def test_a_hub_and_a_chain_have_their_descendants(spark):
    pairs = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1100)]
    tree = _resolve(spark, [*range(300), *range(1000, 1101)], pairs)
    below = {}
    for r in descendant_rows(tree.where("status = 'tree'")).collect():
        below.setdefault(r.node_id, set()).add(r.below)
    assert below[0] == set(range(1, 300)) and below[1000] == set(range(1001, 1101)) and below[1099] == {1100} and 5 not in below


def test_a_hub_elsewhere_does_not_renumber_a_tree(spark, monkeypatch):
    import kernelweave.operators.hierarchy as h

    small = [(1, 2), (1, 3), (1, 4), (4, 5), (1, 6), (1, 7)]
    alone = {r.node_id: (r.first, r.last) for r in _resolve(spark, range(1, 8), small).collect()}
    monkeypatch.setattr(h, "SIBLINGS_PER_BUCKET", 10)
    beside = {r.node_id: (r.first, r.last) for r in _resolve(spark, range(1, 200), small + [(8, k) for k in range(9, 200)]).collect()}
    assert all(beside[n] == alone[n] for n in alone)


def test_links_that_do_not_count_are_reported(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    links = spark.createDataFrame([(1, 3), (2, 3), (1, 9), (8, 2), (None, 2)], "parent long, child long")
    assert {tuple(r) for r in dropped_links(nodes, links).collect()} == {(2, 3, "other parent"), (1, 9, "absent"), (8, 2, "absent")}


def test_an_empty_table_has_no_rows(spark):
    assert _resolve(spark, [], []).count() == 0
