import json

from pyspark.sql import functions as F

from kernelweave.operators.shredding import json_text, number_leaves, shred_list, shred_objects, whole_number


def _wrapped(value, times):
    text = json.dumps(value)
    for _ in range(times):
        text = json.dumps(text)
    return text


def test_any_number_of_layers_is_undone(spark):
    rows = spark.createDataFrame([(k, _wrapped({"a": 'x"y'}, k)) for k in range(11)], "k int, t string")
    assert {r.t for r in rows.select(json_text(F.col("t")).alias("t")).collect()} == {json.dumps({"a": 'x"y'})}


def test_leaves_keep_their_links_however_deeply_they_are_written_as_strings(spark):
    leaf = {"type": "ProvPhi", "label": "l", "child": 2}
    rows = []
    for k in range(9):
        score = {"type": "ProvSum", "sum_operands": [leaf, {"type": "ProvProd", "prod_operands": [leaf, leaf]}]}
        item = {"containment": "x", "score": _wrapped(score, k) if k else score}
        rows.append((k, _wrapped({"objects": [{"id": 7, "phi": [None, item]}]}, k)))
    tables = shred_objects(spark.createDataFrame(rows, "k int, p string"), "k", "p")
    got = {(r.rec_id, r.obj_id, r.item_no, r.leaf_no) for r in number_leaves(tables["score"], "ProvPhi").collect()}
    assert got == {(k, 7, 1, n) for k in range(9) for n in range(3)}


def test_numbers_are_never_rounded(spark):
    texts = {"7": 7, "7.0": 7, "1e3": 1000, "1.9": None, "9007199254740993.0": 9007199254740993, "x": None, None: None, "9223372036854775807": 9223372036854775807}
    rows = spark.createDataFrame([(k,) for k in texts], "t string").select("t", whole_number(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == texts


def test_odd_payloads_have_no_children(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "7"), (6, '{"objects": null}')], "k int, p string")
    assert shred_objects(rows, "k", "p")["objects"].count() == 0
    assert shred_list(rows, "k", "p", "sources").count() == 0
