from pyspark.sql import functions as F

from kernelweave.llm.topn import top_n


def _top(spark, rows, schema, n, desc=True):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in top_n(df, ["g"], [(F.col("v"), desc)], "item", n).collect())


def test_whole_numbers_beyond_double_precision_keep_their_order(spark):
    rows = [("a", 9007199254740992, 1), ("a", 9007199254740993, 2), ("a", -(2**63), 3), ("a", 2**63 - 1, 4)]
    assert _top(spark, rows, "g string, v long, item long", 2) == [("a", 2, 2), ("a", 4, 1)]


def test_nulls_come_last_ties_go_by_item_and_repeats_count_once(spark):
    rows = [("a", 1.5, 3), ("a", 1.5, 2), ("a", 1.5, 2), ("a", None, 1), (None, 2.0, 9), (None, 1.0, 8), (None, 3.0, 7), ("b", None, 5)]
    got = {tuple(r) for r in top_n(spark.createDataFrame(rows, "g string, v double, item long"), ["g"], [(F.col("v"), True)], "item", 2).collect()}
    assert got == {("a", 2, 1), ("a", 3, 2), (None, 7, 1), (None, 9, 2), ("b", 5, 1)}


def test_an_empty_table_has_no_rows(spark):
    assert _top(spark, [], "g string, v long, item long", 2) == []


def test_many_blocks_agree_with_brute_force(spark, monkeypatch):
    import kernelweave.llm.topn as topn

    rows = [(k % 3, (k * 7919) % 1000, k) for k in range(5000)]
    want = sorted((g, i, k + 1) for g in range(3) for k, (_, i) in enumerate(sorted((-v, i) for h, v, i in rows if h == g)[:3]))
    monkeypatch.setattr(topn, "BLOCK", 50)
    assert _top(spark, rows, "g int, v int, item long", 3) == want
