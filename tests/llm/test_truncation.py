from kernelweave.llm.truncation import truncated


def test_endings_and_limits_show_cut_texts(spark):
    whole = ["It is old.", 'He said "no!"', "Heading Without A Stop", "One. Two.\n#old #tram", "One.\n-- Hestor, desk 4", "One. http://notes.example/12", "1. a tram\n2. a bus", "", "  ", None, "One.\nRef. 2024/12"]
    lost = ["It is old. The tra", "It is old…", "It is [...]", "One.\n\nThe tram is", "It is ol�", "One line ends.\r\nThe next &am"]
    piled = [("lines of tram " + "x" * k + " " + "y" * 200)[:150] for k in range(5)]
    rows = [(k, "s", t) for k, t in enumerate([*whole, *lost, *piled])]
    got = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == set(range(len(whole), len(rows)))


def test_every_source_has_its_share(spark):
    from __spark_entry__ import queries

    d = "/root/testdata/sf0.001"
    share = queries()["p10_share"](spark, d).collect()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert sum(r.n_documents for r in share) == docs.count() and len(share) == docs.select("source").distinct().count()
    assert sum(r.n_cut for r in share) == queries()["p10_found"](spark, d).count() > 0
