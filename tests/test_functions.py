import pytest
from pyspark.sql import functions as F

from pagelake.functions import jsons, templates
from pagelake.functions import text as tx
from pagelake.functions import urls
from pagelake.operators import catalog, traffic


def column(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("path", "pattern"),
    [
        ("/api/products/12345", "/api/products/{}"),
        ("/x/123e4567-e89b-12d3-a456-426614174000", "/x/{}"),
        ("/x/abc123def456ghi789jkl", "/x/{}"),
        ("/api/v2/products/list", "/api/v2/products/list"),
        ("/api/search?q=test&page=1", "/api/search"),
        ("/a/1/b/2", "/a/{}/b/{}"),
        ("/", "/"),
    ],
)
def test_normalize(spark, path, pattern):
    assert column(spark, urls.normalize_path, path) == pattern
    assert column(spark, urls.normalize_path, pattern) == pattern


@pytest.mark.parametrize(("pattern", "score"), [("/api/v2/products", 30), ("/api/products/{}", 21), ("/{}/{}", 2), ("/api", 10)])
def test_specificity(spark, pattern, score):
    assert column(spark, urls.specificity, pattern) == score


def test_match(spark):
    targets = spark.createDataFrame([("https://a.com/product/12345",), ("https://a.com/x",), ("https://b.com/product/1",)], "url string")
    stored = spark.createDataFrame([("a.com", "/{}/{}", 1), ("a.com", "/product/{}", 2), ("a.com", "/product/99", 3)], "domain string, url_pattern string, ord int")
    assert [(r.url, r.url_pattern) for r in catalog.match_patterns(targets, stored).collect()] == [("https://a.com/product/12345", "/product/{}")]


def test_odd_urls(spark):
    for url in (None, "", "no url", "http://", "http://[bad", "https://u:p@h:1/x?y#z"):
        row = spark.createDataFrame([(url,)], "v string").select(urls.authority(F.col("v")).alias("a"), urls.path(F.col("v")).alias("p")).first()
        assert url is None or row.p
    assert row.a == "h:1" and row.p == "/x"


@pytest.mark.parametrize(("text", "value"), [("1,234", "1234"), ("$29.99", "29.99"), ("1.2k", "1200"), ("2.5m", "2500000"), ("  42  ", "42"), ("", ""), ("-5", "-5")])
def test_clean_number(spark, text, value):
    assert column(spark, tx.clean_number, text) == value


@pytest.mark.parametrize(("n", "wait"), [(0, 100), (1, 200), (5, 2000)])
def test_backoff(spark, n, wait):
    assert column(spark, lambda v: tx.backoff_ms(v, 100, 2000), n, "int") == wait


@pytest.mark.parametrize(("name", "kind"), [("BlogPosting", "article"), ("ProfilePage", "profile"), ("Product", "product"), ("ItemList", "listing"), ("WebSite", "generic")])
def test_schema_type(spark, name, kind):
    assert column(spark, tx.schema_type, name) == kind


def test_texts(spark):
    assert column(spark, lambda v: tx.cut_bytes(v, 2), "aé") == "a"
    assert column(spark, tx.collapse_whitespace, " a\n\t b  c") == "a b c"
    assert column(spark, tx.clean_lines, "one line\nab\nPlease Sign In\none line\ntwo lines") == "one line\ntwo lines"
    # only blanks are trimmed, not the digits of the line's index; lines that differ by blanks are repeated ones
    assert column(spark, tx.clean_lines, "0 zero 0\n1 one 1\n one line \none line\n  ab\n3 three 3") == "0 zero 0\n1 one 1\none line\n3 three 3"
    assert column(spark, tx.clean_body, "nice text, loading ...") == ""
    assert column(spark, tx.action_name, " List-All  Items! ") == "list_all_items"
    assert column(spark, tx.strip_fence, '```json\n{"a":1}\n```') == '{"a":1}'
    assert column(spark, tx.strip_script_style, "a<script>x</script>b<style>") == "ab<style>"
    assert column(spark, tx.ttl_seconds, "7d") == 604800 and column(spark, tx.ttl_seconds, "x") is None


def test_har(spark):
    rows = [(1, 1, "GET", "https://a/products", "application/json"), (1, 2, "GET", "https://a/style.css", "text/css"), (1, 3, "GET", "https://a/analytics", "text/json"), (1, 4, "GET", "https://a/products", "application/json"), (1, 5, "POST", "https://a/orders", "application/GraphQL")]
    har = spark.createDataFrame(rows, "capture_id int, ord int, method string, url string, content_type string")
    once = traffic.filter_har(har)
    assert sorted(r.ord for r in once.collect()) == [1, 5]
    assert sorted(r.ord for r in traffic.filter_har(once).collect()) == [1, 5]


@pytest.mark.parametrize(("status", "body", "blocked"), [(403, "Press & Hold", True), (200, "Just a moment...", True), (200, "datadome", False), (404, "robot or human", False), (503, "fine", False)])
def test_blocked(spark, status, body, blocked):
    row = spark.createDataFrame([(status, body)], "s int, b string").select(traffic.is_blocked(F.col("s"), F.col("b")).alias("r")).first()
    assert row.r is blocked


def test_included_and_merge(spark):
    bodies = [(1, 1, '{"included":[{"entityUrn":"a","v":1},{"v":2}]}'), (1, 2, '{"included":[{"entityUrn":"a","v":3},{"v":2}]}'), (1, 3, "broken")]
    merged = traffic.merge_included(spark.createDataFrame(bodies, "capture_id int, ord int, body string")).collect()
    assert sorted((r.ord, r.pos, r.urn) for r in merged if r.urn) == [(1, 0, "a")] and len(merged) == 3


def test_infer_and_repair():
    assert jsons.infer_schema({"tags": ["a"], "n": None, "e": []}) == {"type": "object", "fields": [{"name": "e", "type": "array"}, {"name": "n", "type": "null"}, {"name": "tags", "type": "array", "items": {"type": "string"}}]}
    deep = jsons.infer_schema({"a": {"b": {"c": {"d": 1}}}})
    assert deep["fields"][0]["fields"][0]["fields"][0] == {"name": "c", "type": "object"}
    assert jsons.repair('{"a":["x') == '{"a":["x"]}' and jsons.repair('{"a":1}') == '{"a":1}'
    assert jsons.truncate({"t": "this is a long text", "l": [1, 2, 3, 4]}, 10) == {"t": "this is a ...", "l": [1, 2, 3]}
    assert jsons.count_keys([{"a": {"b": {"c": 1}}}], 2) == 2
    assert list(jsons.key_tree({"a": [{"b": 1}, {"c": 2}]})) == [(".a", "array"), (".a[]", "object"), (".a[].b", "number")]


@pytest.mark.parametrize(
    ("program", "out"),
    [(".a.b", ["1"]), (".l[]", ["1", "x", "null"]), (".l[-1]", ["null"]), (".l | length", ["3"]), ("keys", ['["a","l","o"]']), (".o[] | select(.k == \"v\") | .n", ["5"]), (".o | map(.n)", ["[5,6]"]), (".a.b.c?", []), (".a.b.c", [])],
)
def test_jq(program, out):
    assert jsons.run_jq('{"a":{"b":1},"l":[1,"x",null],"o":[{"k":"v","n":5},{"k":"w","n":6}]}', program) == out


def test_jq_faults():
    with pytest.raises(jsons.JqError):
        jsons.compile_jq("reduce .[] as $x (0; . + $x)")
    assert jsons.run_jq("not json", ".") is None


def test_templates(spark):
    url = "https://s.com/en/items/42/view?page=3"
    strict = lambda t, v: column(spark, lambda u: templates.fill_strict(F.lit(t), u, v), url)
    assert strict("/{l}/{id}", [("l", "path", "0"), ("id", "path", r"^\d+$")]) == "/en/42"
    assert strict("/{x}", [("x", "path", "9")]) is None and strict("/{x}", [("x", "path", "^zzz$")]) is None
    assert strict("/{r}/{p}/{f}", [("r", "path_rest", "1"), ("p", "query", "page"), ("f", "fixed", "k")]) == "/items/42/view/3/k"
    assert column(spark, lambda u: templates.fill_lenient(F.lit("/{x}/{l}"), u, [("x", "path", "9"), ("l", "path", "0")]), url) == "/{x}/en"
    with pytest.raises(templates.TemplateError):
        strict("/{x}", [("x", "cookie", "9")])
    assert templates.render("a {{x}} {{cookie.c}} {{none}}", {"x": "1"}, {"c": "2"}) == "a 1 2 "
    assert templates.render_json('{"a":{{x|json}},"l":{{y|json_array}},"n":{{z}}}', {"x": 'q"', "y": "a, b", "z": "3"}) == '{"a":"q\\"","l":["a", "b"],"n":3}'
    assert templates.render_form("q={{x}}", {"x": "a b&c"}) == "q=a+b%26c"
    for bad in ("{{x", "{{x|nope}}"):
        with pytest.raises(templates.TemplateError):
            templates.render(bad, {}) if "|" not in bad else templates.render_json(bad, {})


def test_url_actions(spark):
    rows = spark.createDataFrame([("https://s.com/find?query=tea&page=2&x=1",), ("https://s.com/plain",)], "url string")
    found = {(r.url[-5:], r.name): r.url_template for r in catalog.url_actions(rows).collect()}
    assert found["2&x=1", "search"] == "https://s.com/find?query={query}&x=1" and len(found) == 4
    assert found["2&x=1", "paginate"] == "https://s.com/find?page={page}&query={query}&x=1"
