from pyspark.sql import functions as F

from kernelweave.llm.frequency import terms, value_counts


def test_fields_keep_their_names_and_terms_count_across_positions(spark):
    rows = spark.createDataFrame([(1, "Red tram, red", "en"), (2, "the RED tram", None), (3, None, "en")], "rel_id long, t string, lang string")
    got = {tuple(r) for r in value_counts(rows, "rel_id", {"term": terms(F.col("t")), "lang": F.array("lang")}).collect()}
    assert got == {("term", "red", 3, 2), ("term", "tram", 2, 2), ("term", "the", 1, 1), ("lang", "en", 2, 2)}


def test_record_ids_may_be_texts_or_absent_and_common_values_span_partitions(spark):
    rows = [(None if k % 5 == 0 else f"r{k % 50}", "a a b" if k % 2 else "a") for k in range(4000)]
    got = {r.value: (r.occurrences, r.records) for r in value_counts(spark.createDataFrame(rows, "id string, t string").repartition(7), "id", {"term": terms(F.col("t"))}).collect()}
    assert got == {"a": (6000, 41), "b": (2000, 21)}
    empty = spark.createDataFrame([], "id long, t string")
    assert value_counts(empty, "id", {"term": terms(F.col("t"))}).count() == 0


def test_p4_found_gives_what_its_sql_gives(against_sql):
    assert against_sql("p4_found") > 0
