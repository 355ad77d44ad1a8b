import json
import random

from kernelweave.operators.malformed import load_assertions, nested_object

GOOD = '{"a": 1}'


def _line(*, start="/c/en/a", end="/c/en/b", data=GOOD, weight="1.0", n=7):
    return "\t".join(["1", "/a/x", "/r/IsA", start, end, weight, data][:n])


CASES = {
    None: [_line(), _line() + "\r", _line(end="https://x.example/a"), _line(data='"{""a"":\t""b""}"'), _line(data='{"a":' * 30 + "1" + "}" * 30), _line(weight="heavy"), _line(data='{"a": 1, "a": 2}')],
    "quoting": [_line(data='"{""a"": 1}'), _line(data='"{}" x'), '"', '\t"a\tb'],
    "columns": [_line(n=6), "", _line() + "\tx", None],
    "bad_data": [_line(data="[1]"), _line(data="{'a': 1}"), _line(data='{"a": NaN}'), _line(data='{"a": 1} {}'), _line(data=""), _line(data='{"a": 01}')],
    "bad_start": [_line(start="/c/EN/a"), _line(start="/c/en/"), _line(start="http://x.example"), _line(start="/c/en/a b")],
    "bad_end": [_line(end="/c/engl/a"), _line(end="ftp://x"), _line(end="/c/en//x")],
}


def test_every_line_is_loaded_or_rejected_with_its_first_reason(spark):
    rows = [(k, line, reason) for k, (reason, line) in enumerate((r, x) for r, xs in CASES.items() for x in xs)]
    df = spark.createDataFrame([(k, line, "f", "own") for k, line, _ in rows], "line_id long, raw_line string, file_name string, errors string")
    loaded, rejected = load_assertions(df)
    assert {r.line_id: r.reason for r in rejected.collect()} == {k: reason for k, _, reason in rows if reason}
    assert {r.line_id for r in loaded.collect()} == {k for k, _, reason in rows if not reason}
    assert {r.raw_line for r in rejected.collect()} == {line for _, line, reason in rows if reason} and {"file_name", "in_errors"} <= set(rejected.columns)
    assert [r.warnings for r in loaded.collect() if r.weight is None] == [["bad_weight"]]


def test_rules_are_evaluated_once(spark):
    loaded, rejected = load_assertions(spark.createDataFrame([(1, _line())], "line_id long, raw_line string"))
    for side in (loaded, rejected):
        assert side._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_nesting_beyond_the_parsers_depth_is_judged_by_a_stack(spark):
    deep = '{"a":' * 20_000 + "1" + "}" * 20_000
    loaded, rejected = load_assertions(spark.createDataFrame([(1, _line(data=deep)), (2, _line(data=deep + "}"))], "line_id long, raw_line string"))
    assert [r.line_id for r in loaded.select("line_id").collect()] == [1] and [r.reason for r in rejected.select("reason").collect()] == ["bad_data"]


def test_the_stack_agrees_with_the_parser():
    rng = random.Random(1)
    signs = ['{', '}', '[', ']', ',', ':', '"a"', '1', '-0.5e3', 'true', 'null', ' ', '01', '"\\u00e9"', '"\\x"']
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(20_000)] + ['{"a":[{},[]],"b":{"c":null}}', "{}", " {} ", '{"a" : 1 , "b" : [ 1 , 2 ] }']

    def refuse(_):
        raise ValueError

    for text in texts:
        try:
            want = isinstance(json.loads(text, parse_constant=refuse), dict)
        except ValueError:
            want = False
        assert nested_object(text) == want, text
