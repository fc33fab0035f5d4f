import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.functions.css import SelectorError, compile_selector, select_all
from pagelake.functions.dom import cut_bytes, parse_html
from pagelake.functions.scan import embedded, sanitize_literals, unescape_js
from pagelake.operators.extract import MAX_BODY, extract_page
from pagelake.operators.rules import Field, Rules, check_rules, clean_content, entities, number, number_text, row_groups, table_rows
from pagelake.operators.structured import page_type, structured_record

BASE = "https://example.com/"
FULL = """<!DOCTYPE html><html lang="en"><head><title> Test Page </title><meta name="description" content="A test"><meta name="keywords" content="a,b">
<meta name="viewport" content="w"><meta property="og:title" content="OG"><meta property="og:image" content="/i.png"><link rel="canonical" href="https://example.com/c">
<script type="application/ld+json">{"@type":"Article","headline":"H"}</script></head><body><h1>Main</h1><p>Text<h2>Sub</h2>
<a href="/about">About</a><a href="https://other.com/">Other</a><a href="#x">no</a><a href="javascript:1">no</a><a href="/about">again</a>
<img src="/p.jpg" alt="P"><img src="data:xx"></body></html>"""


def test_full_page():
    page = extract_page(FULL, BASE)
    assert (page["title"], page["description"], page["language"], page["canonical"]) == ("Test Page", "A test", "en", "https://example.com/c")
    assert page["headings"] == [{"level": 1, "text": "Main"}, {"level": 2, "text": "Sub"}]
    assert [x["href"] for x in page["links"]] == ["https://example.com/about", "https://other.com/"]
    assert page["images"] == [{"src": "https://example.com/p.jpg", "alt": "P"}]
    assert page["open_graph"] == {"title": "OG", "image": "/i.png"} and page["meta"] == {"keywords": "a,b"}
    assert len(page["json_ld"]) == 1 and not page["has_article"]


@pytest.mark.parametrize("html", ["", "<", "<p><b>x<br><p>y", "<div><span>", "</p></div>", "<table><tr><td>1<tr><td>2", "\x00<html><title>a"])
def test_broken_markup(html):
    assert set(extract_page(html, BASE)) >= {"title", "links"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab=\"' !-ptdrhe1&;{}[]x", max_size=200))
def test_never_raises(html):
    extract_page(html, BASE)
    structured_record(html, BASE)


def test_caps_and_scripts():
    page = extract_page("<body><script>var x=1</script><style>p{}</style>" + "<h2>t</h2>" * 70 + "".join(f'<a href="/{k}">l</a>' for k in range(80)) + "é" * 4000 + "</body>", BASE)
    assert len(page["headings"]) == 50 and len(page["links"]) == 50
    assert len(page["body_text"].encode()) <= MAX_BODY and "var x" not in page["body_text"]


def test_main_content_without_noise():
    html = "<body><nav>menu</nav><main><p>keep <b>this</b></p><div class='overflow-hidden'>hid</div><footer>foot</footer></main>after</body>"
    assert extract_page(html, BASE)["body_text"] == "keep this"


def test_get_form():
    html = '<form action="/search"><input name="q" required><input type="hidden" name="lang" value="en"><input type="checkbox" name="c"><select name="sort"><option value="n">N<option value="o" selected>O</select></form><form></form>'
    forms = extract_page(html, BASE)["forms"]
    assert len(forms) == 1 and forms[0]["action"] == "https://example.com/search" and forms[0]["method"] == "GET"
    assert [(f["name"], f["type"], f["value"], f["required"]) for f in forms[0]["fields"]] == [("q", "text", "", True), ("lang", "hidden", "en", False), ("sort", "select", "o", False)]


def test_embedded_patterns():
    found = lambda body: embedded(parse_html(body))
    assert found('<script>var ytInitialData = {"a":"}\\"{"};var ytInitialPlayerResponse={"b":[1]};</script>') == {"ytInitialData": {"a": '}"{'}, "ytInitialPlayerResponse": {"b": [1]}}
    assert found('<script>window.__APOLLO_STATE__ = {"x":1};window[\'SIGI_STATE\']={"y":2}</script>') == {"__APOLLO_STATE__": {"x": 1}, "SIGI_STATE": {"y": 2}}
    assert found("<script>window.__INITIAL_STATE__=JSON.parse('{\"k\":\"\\u0041\\x42\"}')</script>") == {"__INITIAL_STATE__": {"k": "AB"}}
    assert found('<script>var ytInitialDataVersion = {"a":1111111}</script>') == {}
    assert found('<script>window.__NUXT__ = {"a":NaN,"b":-Infinity,"c":undefined,"d":1}</script>') == {"__NUXT__": {"a": None, "b": None, "c": None, "d": 1}}
    assert found('<script>window.__NUXT__ = {broken; padding padding</script><script>window.__NUXT__ = {} ; padding</script>') == {}
    long = '{"k":"' + "v" * 120 + '"}'
    assert set(found(f'<script type="application/json" id="page_data">{long}</script><script type="application/json" id="s">{{"a":1}}</script>')) == {"page_data"}
    first = '<script id="SIGI_STATE" type="application/json">{"from":"id"}</script><script>window.SIGI_STATE = {"from":"window"}</script>'
    assert found(first) == {"SIGI_STATE": {"from": "id"}}
    assert sanitize_literals('{"note":"the value was undefined"}') == '{"note":"the value was undefined"}'
    assert unescape_js(r"a\n\'\/\0") == "a\n'/\0"


@pytest.mark.parametrize(
    ("selector", "count"),
    [("p", 2), ("div > p", 1), ("#m", 1), (".a.b", 1), ("a[href^='/']", 2), ("a:last-child", 2), ("p, a", 5), ("li:nth-child(2n+1)", 2), ("li:not(.x)", 2), ("p + a", 1), ("p ~ a", 3), ("div:has(p)", 1), ("a[href$=z]", 1), ("*:contains('two')", 5)],
)
def test_selectors(selector, count):
    html = "<div id=m class='a b'><p>one</p><a href='/x'>x</a><a href='/y'>y</a></div><p>two</p><ul><li class=x>1<li>2<li>3</ul><a href='http://z'>z</a>"
    html = html.replace("<ul>", "<section><span>two</span></section><ul>")
    assert len(select_all(parse_html(html), selector)) == count


@pytest.mark.parametrize("bad", ["", "p[", "::", "p >", ":nth-child(x)", "..a"])
def test_bad_selectors(bad):
    with pytest.raises(SelectorError):
        compile_selector(bad)


@pytest.mark.parametrize(
    ("text", "value"), [("1,234", "1234"), ("$29.99", "29.99"), ("1.2k", "1200"), ("2.5m", "2500000"), ("  42  ", "42"), ("", ""), ("-5", "-5")]
)
def test_number_text(text, value):
    assert number_text(text) == value


def test_rules():
    html = "<nav>n</nav><main><h1>Hello World</h1><span class=by>John Doe</span><time>2026-01-15</time><p>Body <i>text</i></p></main><footer>f</footer>"
    rules = Rules(content_selector="main", title_selector=".none", author_selector=".by", date_selector="time", ignore_selectors=("nav", "footer", "bad["), fields=(Field("x", "time"),))
    out = clean_content(html, rules)
    assert out == {"title": "Hello World", "author": "John Doe", "date": "2026-01-15", "content": "Hello WorldJohn Doe2026-01-15Body text", "fields": {"x": "2026-01-15"}}
    assert clean_content(html, Rules(content_selector=".stale"))["content"] is None
    assert check_rules(rules) and check_rules(Rules(group_size=0)) and not check_rules(Rules(title_selector="h1"))
    repos = "<ul><li class=r><a href=/a>A</a><b>42</b><li class=r><a href=/b>B</a><b>7.1k</b></ul>"
    listed = Rules(entity_fields=(Field("repos", ".r", type="list", item_fields=(Field("name", "a"), Field("stars", "b", type="number"))), Field("gone", ".zz", (".z",), required=True)))
    assert entities(repos, listed) == {"data": '{"repos":[{"name":"A","stars":42},{"name":"B","stars":7100}]}', "missing_required": ["gone"]}
    assert number("12.5") == 12.5 and number("none") is None


def test_table_rows():
    html = "<table id=t><tr><td>1<td class=u>a<tr><td>sub1<tr><td>2<td class=u>b<tr><td>sub2<tr><td>tail</table>"
    rule = Rules(container="#t", group_size=2, row_fields=(Field("n", "td", type="number"), Field("u", ".u", required=True), Field("s", "", row=1)))
    assert row_groups(html, rule) == [{"n": 1, "u": "a", "s": "sub1"}, {"n": 2, "u": "b", "s": "sub2"}]
    assert table_rows("<p>", rule)["data"] is None
    with pytest.raises(ValueError):
        row_groups(html, Rules(container="#t", group_size=0))


def test_structured():
    out = structured_record(FULL, BASE)
    assert out["source"] == "json_ld" and out["page_type"] == "article"
    assert page_type({"open_graph": {"type": "product.item"}}) == "product"
    state = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"a":1,"gdpClientCache":"{\\"x\\":{\\"p\\":1},\\"y\\":{\\"q\\":1,\\"r\\":2}}","totalPages":6,"nextUrl":"/2","totalResultCount":229}}}</script>'
    record = structured_record(state, BASE)["record"]
    assert '"q":1' in record and '"next_url":"https://example.com/2"' in record and '"total_results":229' in record


def test_cut_bytes():
    assert cut_bytes("aé", 2) == "a" and cut_bytes("aé", 3) == "aé"


def test_one_parse_per_page(spark):
    from pyspark.sql import functions as F

    from pagelake.operators.extract import extract_pages

    pages = spark.createDataFrame([(1, "u", "<title>a</title>"), (2, None, None)], "page_id int, url string, html string")
    found = extract_pages(pages, ("title", "links")).filter(F.col("title").isNotNull()).select("title", "links")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [r.title for r in found.collect()] == ["a"]


def test_snapshot_and_preview(spark):
    from pagelake.operators import assembly

    pages = spark.createDataFrame([("<body><ul><li>a<li>b</ul><svg>s</svg></body>", "u", 1), (None, None, 2), ("", "u", 3)], "html string, url string, k int")
    found = {r.k: r.snapshot for r in assembly.dom_snapshots(pages).collect()}
    assert found == {1: "<body><ul><li>a</li>\n<li>b</li></ul></body>\n", 2: "", 3: ""}
    bodies = spark.createDataFrame([('{"b":["x"],"a":{"c":null}}',), ("é" * 1500,), (None,), ("",)], "body string")
    shown = [r.p for r in bodies.select(assembly.preview("body").alias("p")).collect()]
    assert shown == ['{\n  "a": {\n    "c": null\n  },\n  "b": [\n    "x"\n  ]\n}', "é" * 1000 + "...", None, ""]


def test_rules_that_are_too_many_are_refused(spark):
    from pagelake.operators import catalog

    with pytest.raises(ValueError):
        catalog.bounded_rules(spark.range(catalog.MAX_RULES + 1))
    assert catalog.bounded_rules(spark.range(3)).count() == 3
