import pytest
from pyspark.sql import functions as F

from kernelweave.streaming import feeds as S


@pytest.fixture
def drained(spark, tmp_path):
    """Run a function of a stream over all files of a table and read what it wrote."""
    made = iter(range(99))

    def run(table, build, mode="append"):
        at = tmp_path / str(next(made))
        table.repartition(4).write.parquet(f"{at}/in")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        done = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").format("parquet").trigger(availableNow=True).start()
        done.awaitTermination(120)
        return spark.read.parquet(f"{at}/out")

    return run


def test_repeats_are_left_out_of_a_stream(spark, drained):
    rows = spark.read.parquet("/root/testdata/sf0.001/sentence.parquet").select("sent_id", F.col("loaded_at").cast("timestamp").alias("loaded_at"))
    rows = rows.unionByName(rows)
    got = drained(rows, lambda s: S.without_repeats(s, "sent_id", "loaded_at", "900 days"))
    assert got.count() == rows.select("sent_id").distinct().count() == S.without_repeats(rows, "sent_id", "loaded_at", "900 days").count()


def test_closed_windows_of_a_stream_agree_with_the_batch(spark, drained):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    build = lambda s: S.window_counts(s, "ts", "1 day", "400 days", "event_type")
    late = spark.createDataFrame([(rows.agg(F.max("ts")).first()[0], "end", 0.0)], rows.schema).select(F.expr("ts + INTERVAL 900 DAYS").alias("ts"), "event_type", "value")
    got = {tuple(r) for r in drained(rows.unionByName(late), build).where("event_type <> 'end'").collect()}
    assert got == {tuple(r) for r in build(rows).collect()}


def test_phrases_are_found_in_a_stream(spark, drained):
    rows = spark.createDataFrame([(1, "The bus lane is shut"), (2, "bus lanes"), (3, None), (4, "Bus Lane, tram")], "doc_id long, text string")
    got = {tuple(r) for r in drained(rows, lambda s: S.phrase_hits(s, "doc_id", "text", "bus lane", "tram")).collect()}
    assert got == {(1, "bus lane"), (4, "bus lane"), (4, "tram")}
