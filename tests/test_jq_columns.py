"""Compiled jq programs against the interpreter, without Python in the plan."""

import json

import pytest

from pagelake.functions import jq_columns, jsons

BODIES = [
    '{"a": {"b": [1, 2.5, {"c": "x"}], "d e": null}, "n": 3, "s": "é\\"q", "t": true}', '{"a": [], "n": -2, "s": ""}', '{"a": null, "n": "3"}', "[1, 2, 3]", "[]", "null", '"text"', "7", "false", "not json", "",
    '{"items": [{"n": 1, "k": "a"}, {"n": 5, "k": "b"}, {"n": 9}, {"n": null}]}', '{"items": {"x": {"n": 4}, "y": {"n": 2}}}', '{"items": [{"n": 7}, 3, {"n": 8}]}', None,
]
PROGRAMS = [
    ".", ".a", ".a.b", ".a.b[0]", ".a.b[-1]", ".a.b[2].c", ".n", ".a[]", ".a.b[]", ".a.b[]?", ".a?", ".[]", ".[1]", ".items[]", ".items[] | .n", ".items[].n", ".items[] | select(.n > 3)",
    ".items[] | select(.n > 3) | .n", ".items[] | select(.n == 5) | .k", '.items[]? | select(.k == "b")', ".items[] | select(.n != 5) | .n", ". | length", ".a | length", ".s | length", ".n | length", ".a.b | first",
    ".a.b | last", ". | type", ".t | not", ".a | not", ".n | values", ".missing", ".missing.deep[0]", ".items | .[1] | .n", "select(.n >= 3)", "select(.n < 0) | .s",
]


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append(r.result)
    return out


def same(text):
    try:
        return json.loads(text)
    except ValueError:
        return text


@pytest.mark.parametrize("program", PROGRAMS)
def test_results_are_the_interpreters(spark, program):
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    found = jq_columns.query_columns(rows, "body", program)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert jq_columns.compiled(program) and "Python" not in plan and "ArrowEval" not in plan
    wanted = {k: out for k, b in enumerate(BODIES) if b is not None and (out := jsons.run_jq(b, program))}
    assert {k: [same(x) for x in v] for k, v in results(found).items()} == {k: [same(x) for x in v] for k, v in wanted.items()}


def test_what_the_interpreter_does_not_know(spark):
    """Quoted names within a path, and keys of what has none."""
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    assert results(jq_columns.query_columns(rows.filter("id < 3"), "body", '.a."d e"')) == {0: ["null"], 2: ["null"]}
    found = results(jq_columns.query_columns(rows, "body", ". | keys"))
    assert {k: json.loads(v[0]) for k, v in found.items()} == {0: ["a", "n", "s", "t"], 1: ["a", "n", "s"], 2: ["a", "n"], 3: [0, 1, 2], 4: [], 11: ["items"], 12: ["items"], 13: ["items"]}


def test_objects_are_built(spark):
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    found = results(jq_columns.query_columns(rows, "body", '.items[] | {n, "kind": .k, "x y": .n}'))
    assert [json.loads(x) for x in found[11]] == [{"n": n, "kind": k, "x y": n} for n, k in ((1, "a"), (5, "b"), (9, None), (None, None))]
    assert [json.loads(x) for x in found[13]] == [{"n": 7, "kind": None, "x y": 7}]  # an item that is no object ends the results


@pytest.mark.parametrize("program", ["map(.n)", ".a | add", ".[] | select(.a[] > 1)", "{a: .b[]}", "..", ".a as $x | $x"])
def test_other_programs_do_not_compile(program):
    assert jq_columns.compiled(program) is None


def test_a_value_is_computed_once(spark):
    """Nested steps name a value once: before, each use of a member read it again."""
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    found = jq_columns.query_columns(rows, "body", ".items[] | select(.n >= 2) | {n, k}")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") <= 24  # 32 before
