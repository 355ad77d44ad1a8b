import random

from kernelweave.llm.packing import containers, fill, plan, reduce_dominated


def test_every_item_lies_in_one_container_within_its_capacity():
    for seed in range(60):
        rng = random.Random(seed)
        counts = {s: rng.randint(1, 30) for s in rng.sample(range(101), rng.randint(1, 40))}
        load, seen = {}, {}
        for size, low, high, first in plan(counts, 100):
            for k in range(low, high + 1):
                assert (size, k) not in seen
                seen[size, k] = 1
                at = first + k - low if size else 0
                load[at] = load.get(at, 0) + size
        assert len(seen) == sum(counts.values()) and max(load.values()) <= 100
        assert len(load) <= 1.25 * -(-sum(s * c for s, c in counts.items()) // 100) + sum(c for s, c in counts.items() if s > 50)


def test_certain_partners_are_closed():
    closed, rest = reduce_dominated({100: 2, 70: 1, 60: 2, 40: 1, 30: 1}, 100)
    assert sorted(closed) == [((60,), 1), ((60, 40), 1), ((70, 30), 1), ((100,), 2)] and not rest


def test_long_texts_are_split_and_nothing_is_lost(spark):
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([0, 5, 10, 10, 20, 25, 3])], "doc_id long, n_tokens int").cache()
    got = containers(sizes, 10)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[:3] for r in rows) == [(0, 0, 0), (1, 0, 5), (2, 0, 10), (3, 0, 10), (4, 0, 10), (4, 1, 10), (5, 0, 10), (5, 1, 10), (5, 2, 5), (6, 0, 3)]
    filled = fill(got, 10).collect()
    assert len(filled) == 8 and max(r.fill for r in filled) <= 10 and sum(r.fill for r in filled) == 73
