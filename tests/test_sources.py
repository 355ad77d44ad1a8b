import gzip
import json

from kernelweave.operators.malformed import load_assertions
from kernelweave.sources import readers, writers


def test_a_corpus_of_lines_is_numbered_in_order(spark, tmp_path):
    texts = [f"- 'it''s {k}'" if k % 3 == 0 else f'- "say \\"{k}\\""' if k % 3 == 1 else f"- plain {k}" for k in range(50)]
    (tmp_path / "c.yaml").write_text("\n".join(texts))
    got = [r.text for r in readers.sentences(spark, str(tmp_path / "c.yaml")).orderBy("sent_id").collect()]
    assert got == [f"it's {k}" if k % 3 == 0 else f'say "{k}"' if k % 3 == 1 else f"plain {k}" for k in range(50)]
    assert [tuple(r) for r in readers.sentences(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]


def test_a_gazetteer_is_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "e1", 'A "B" C', "LOC"), (2, "e2", "D", None)], readers.GAZETTEER_SCHEMA)
    writers.write_tsv(rows, str(tmp_path / "g"))
    got = {tuple(r) for r in readers.gazetteer(spark, str(tmp_path / "g"), "Own").collect()}
    assert got == {("Own", 1, "e1", 'A "B" C', "LOC"), ("Own", 2, "e2", "D", None)}


def test_assertion_dumps_may_be_packed(spark, tmp_path):
    line = "1\t/a/x\t/r/IsA\t/c/en/a\t/c/en/b\t1.0\t{}"
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(f"{line}\nbroken\n")
    rows = readers.assertion_lines(spark, str(tmp_path / "a.csv.gz"))
    loaded, rejected = load_assertions(rows.withColumnRenamed("file_name", "line_id"))
    assert loaded.count() == 1 and [r.reason for r in rejected.collect()] == ["columns"]


def test_triples_survive_a_round_trip(spark, tmp_path):
    rows = [("http://x/a", "http://x/p", 'say "hi"\nback\\slash', "literal", "http://www.w3.org/2001/XMLSchema#string"), ("_:b1", "http://x/p", "http://x/b", "iri", None), ("http://x/a", "http://x/q", "_:b1", "bnode", None), ("http://x/a", "http://x/q", "plain", "literal", None)]
    writers.write_triples(spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_type string"), str(tmp_path / "t"))
    assert {tuple(r) for r in readers.triples(spark, str(tmp_path / "t")).collect()} == set(rows)


def test_prefixes_are_widened(spark, tmp_path):
    (tmp_path / "o.ttl").write_text('@prefix ex: <http://x/> .\n# remark\nex:cat a ex:Animal .\nex:cat ex:name "Cat" .\n')
    got = {(r.s, r.p, r.o) for r in readers.triples(spark, str(tmp_path / "o.ttl")).collect()}
    assert got == {("http://x/cat", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://x/Animal"), ("http://x/cat", "http://x/name", "Cat")}


def test_words_prepositions_rules_and_graphs(spark, tmp_path):
    (tmp_path / "w.txt").write_text("go\n run \n\ngo\n")
    rejected = spark.createDataFrame([("run",)], "word string")
    assert {tuple(r) for r in readers.word_list(spark, str(tmp_path / "w.txt"), "Verb", "Motion", rejected=rejected).collect()} == {("go", "Verb"), ("go", "Motion")}
    (tmp_path / "p.json").write_text(json.dumps([{"name": "with", "canOmit": True}, {"name": "w/", "abbreviationOf": "with"}, {"name": "by", "isComplex": True}]))
    flags = {r.name: (r.base, r.canOmit, r.isComplex) for r in readers.prepositions(spark, str(tmp_path / "p.json")).collect()}
    assert flags == {"with": (None, True, False), "w/": ("with", True, False), "by": (None, False, True)}
    (tmp_path / "r.json").write_text(json.dumps([{"construct": "space", "property": "in", "premises": {"kind": ["LOC", "GPE"]}, "not": {"mark": ["x"]}}, {"construct": "time", "premises": {"kind": ["DATE"]}}]))
    got = {tuple(r) for r in readers.ordered_rules(spark, str(tmp_path / "r.json")).collect()}
    assert got == {(0, "space", "in", "kind", "LOC", False), (0, "space", "in", "kind", "GPE", False), (0, "space", "in", "mark", "x", True), (1, "time", None, "kind", "DATE", False)}
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "result.json").write_text(json.dumps([{"id": 3, "ell": ["noun"], "xi": [], "properties": {"pos": "1"}, "phi": [{"containment": "dobj", "content": 4}]}]))
    row = readers.graph_objects(spark, str(tmp_path / "*" / "result.json")).first()
    assert (row.sent_id, row.id, row.phi[0].content, row.properties["pos"]) == (7, 3, 4, "1")


def test_a_stage_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    at = str(tmp_path / "s")
    assert [writers.stage(spark, at, make)[1] for _ in range(3)] == [False, True, True] and len(made) == 1
    assert writers.stage(spark, at, make, force=True)[1] is False and len(made) == 2
