"""Templates that differ by row, and the requests and responses of endpoints."""

import json

import pytest
from pyspark.sql import functions as F

from pagelake.functions import row_templates as rt
from pagelake.operators import requests

ARGS = {"x": 'q"<&', "y": " a, b ,,é", "z": "3", "blank": " ", "line": "a\nb\\", "nest": "{{x}}", "sp": "a b*~ü"}
CASES = [
    ("render", "a {{x}} {{cookie.c}} {{none}} {{ z }}", 'a q"<& 2  3'),
    ("render", "{{z}}", "3"), ("render", "", ""), ("render", "no slots }} {", "no slots }} {"), ("render", "{{z}}{{z}}\n{{\nz\n}}", "33\n3"),
    ("render", "a {{ b {{ z }} d", "a  d"), ("render", "a {{z}} {{", None), ("render", "{{nest}}", "{{x}}"), ("render", "{{x|json}}", ""),
    ("render_form", "q={{x}}&s={{sp}}&n={{none}}", "q=q%22%3C%26&s=a+b%2A~%C3%BC&n="),
    ("render_json", '{"a":{{x|json}},"b":"{{x}}","n":{{z}}}', '{"a":"q\\"\\u003c\\u0026","b":"q\\"\\u003c\\u0026","n":3}'),
    ("render_json", "[{{y | json_array}}] [{{blank|json_array}}]", '["a","b","","é"] []'), ("render_json", '"{{line}}"', '"a\\nb\\\\"'),
    ("render_json", "{{z|string}}", None), ("render_json", "{{z|json", None),
]


def test_templates_of_each_row(spark):
    rows = spark.createDataFrame([(k, how, t, ARGS, {"c": "2"}) for k, (how, t, _) in enumerate(CASES)], "k int, how string, t string, v map<string,string>, c map<string,string>")
    made = {how: getattr(rt, how)(F.col("t"), F.col("v"), F.col("c")) for how in ("render", "render_form", "render_json")}
    found = rows.select("k", F.coalesce(*[F.when(F.col("how") == how, c) for how, c in made.items()]).alias("out"))
    assert {r.k: r.out for r in found.collect()} == {k: want for k, (_, _, want) in enumerate(CASES)}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert json.loads(CASES[10][2]) == {"a": ARGS["x"], "b": ARGS["x"], "n": 3}


@pytest.mark.parametrize(("source", "pattern", "want"), [
    ("path", "0", "en"), ("path", "2", "a+b c"), ("path", "5", None), ("path", "-1", None), ("path", r"^\d+$", "77"), ("url", r"(?P<n>\d)7", "77"), ("path", "zzz", None), ("path", "(", "last"),
    ("path_rest", "1", "77/a+b c/last"), ("path_rest", "9", None), ("path_rest", "x", None), ("query", "q", "x y"), ("query", "none", ""), ("fixed", "v1", "v1"), ("cookie", "a", None),
])
def test_variables(spark, source, pattern, want):
    row = spark.createDataFrame([("https://a.com/en/77/a+b%20c/last/?q=x+y&q=2#f", [("n", source, pattern)])], f"url string, v {rt.VARIABLES}")
    found = row.withColumn("v", rt.checked(F.col("v"))).select(rt.fill(F.lit("<{n}|{n}>"), F.col("v"), F.col("url")))
    assert found.first()[0] == (None if want is None else f"<{want}|{want}>")


def test_scan_of_endpoints(spark):
    targets = spark.createDataFrame([("a.com", "https://a.com/p/7", {"x-one": "o"}), ("a.com", "https://a.com/p/zz", None), ("b.com", "https://b.com/", None), ("c.com", "https://c.com/", None)], "domain string, url string, overrides map<string,string>")
    schema = f"domain string, name string, method string, url_template string, variables {rt.VARIABLES}, headers map<string,string>, body_template string, content_type string"
    endpoints = spark.createDataFrame([
        ("a.com", "get", "get", "https://api.a.com/{id}", [("id", "path", r"^\d+$")], {"X-One": "e", "accept": "j"}, None, None),
        ("a.com", "post", "POST", "https://api.a.com/q", [("id", "path", "1")], None, '{"id":"{id}"}', "application/json"),
        ("b.com", "all", None, "https://api.b.com/", None, {"user-agent": "other"}, None, ""),
    ], schema)
    answers = spark.createDataFrame([
        (1, "GET", "https://api.a.com/7", None, 500, "old"), (2, "get", "https://api.a.com/7", None, 200, "[7]"), (3, "POST", "https://api.a.com/q", '{"id":"7"}', 503, "busy"),
        (4, "POST", "https://api.a.com/q", '{"id":"zz"}', 404, "none"),
    ], "ord int, method string, url string, request_body string, status int, body string")
    found = {(r.url, r.name): r for r in requests.scan_endpoints(targets, endpoints, answers).collect()}
    outcome = {k: (r.outcome, r.status, r.data) for k, r in found.items()}
    seven, zz = "https://a.com/p/7", "https://a.com/p/zz"
    assert outcome == {(seven, "get"): ("ok", 200, "[7]"), (zz, "get"): ("unresolved", None, None), (seven, "post"): ("transient", 503, None), (zz, "post"): ("broken", 404, None), ("https://b.com/", "all"): ("missing", None, None)}
    assert found[seven, "get"].headers == {"User-Agent": "pagelake", "X-One": "o", "Accept": "j"}
    assert found[zz, "post"].headers == {"User-Agent": "pagelake", "Content-Type": "application/json"} and found["https://b.com/", "all"].headers == {"User-Agent": "other"}
    assert requests.scan_endpoints(targets.limit(0), endpoints, answers).count() == 0
