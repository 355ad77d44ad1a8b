from kernelweave.llm.duplicates import collapsed_facts, duplicate_members

ROWS = [
    (1, "en", "SameAs", "Red Tram", "queue"), (2, "en", "SameAs", "red-tram", " Queue "), (3, "en", "SameAs", "QUEUE", "red tram!"), (4, "en", "IsA", "red tram", "queue"), (5, "en", "IsA", "queue", "red tram"),
    (6, "en", "IsA", "red tram", "queue"), (7, None, "IsA", "red tram", "queue"), (8, "en", "IsA", None, "queue"), (9, "en", "IsA", "café", "queue"), (10, "en", "IsA", "cafe", "queue"),
]


def _tables(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], "rel_id long, lang string, rel string, surface_start string, surface_end string, n string")
    return rows, spark.createDataFrame([("SameAs", True), ("IsA", False)], "label string, is_symmetric boolean")


def test_members_of_a_fact_whatever_the_formatting(spark):
    assert sorted(tuple(r) for r in duplicate_members(*_tables(spark)).collect()) == [(1, 2), (1, 3), (4, 6)]


def test_every_fact_once_with_its_copies(spark):
    got = {r.rel_id: r.copies for r in collapsed_facts(*_tables(spark)).collect()}
    assert got == {1: 3, 4: 2, 5: 1, 9: 1, 10: 1}


def test_an_empty_table_has_no_facts(spark):
    rows, relations = _tables(spark)
    assert duplicate_members(rows.limit(0), relations).count() == 0
