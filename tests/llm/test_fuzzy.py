from kernelweave.llm.fuzzy import match_names


def test_typed_names_find_their_entry(spark):
    names = spark.createDataFrame([("ORG", "e1", "Logresté Bakery"), ("ORG", "e1", "VWVH"), ("LOC", "e2", "Wimoolor"), ("LOC", "e3", "North Adamoor"), ("LOC", "e4", "South Adamoor")], "kind string, entry string, name string")
    asked = {1: ("ORG", "Bakery, LOGRESTE"), 2: ("ORG", "V.W.V.H."), 3: ("ORG", "VWVK"), 4: ("LOC", "Wmioolor"), 5: ("LOC", "VWVH"), 6: ("LOC", "nouth adamoor"), 7: ("LOC", "nth-adamoor"), 8: ("LOC", "??"), 9: ("ORG", "lorgeste bakery "), 10: (None, "VWVH")}
    want = {1: "e1", 2: "e1", 3: "none", 4: "e2", 5: "none", 6: "none", 7: "e3", 8: "none", 9: "e1", 10: "none"}
    got = match_names(spark.createDataFrame([(k, *v) for k, v in asked.items()], "item long, kind string, name string"), names).collect()
    assert sorted((r.item, r.entry) for r in got) == sorted(want.items())


def test_p3_found_gives_what_its_sql_gives(against_sql):
    assert against_sql("p3_found") > 0
