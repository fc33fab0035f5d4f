"""Composed catalogs against a direct program, and written-out cases."""

import random
from urllib.parse import parse_qsl, quote_plus

import pytest
from pyspark.sql import functions as F

from pagelake.operators import action_catalog as ac

FIELDS = "array<struct<name:string,type:string,value:string,required:boolean>>"
PAGES = f"url string, links array<struct<text:string,href:string>>, forms array<struct<action:string,method:string,fields:{FIELDS}>>"
ENDPOINTS = "array<struct<name:string,method:string,url_template:string,confidence:double,variables:array<struct<name:string,source:string>>,query_params:array<struct<key:string,value:string,required:boolean>>>>"
DECLARED = f"array<struct<name:string,kind:string,transport:string,method:string,url_template:string,source:string,confidence:double,params:{ac.PARAMS}>>"
SCHEMAS = f"url string, coverage string, endpoints {ENDPOINTS}, actions {DECLARED}"
SEARCH, PAGE = ["q", "query", "search", "keyword", "keywords", "k", "term", "nkw"], ["page", "pagenum", "pageno", "pagenumber", "pgn", "pg"]


def token(key):
    return "".join(c for c in key.lower() if c.isascii() and c.isalnum())


def searches(key):
    return any(s in key.lower() or s in token(key) for s in SEARCH)


def parts(url):
    base, _, rest = url.partition("#")
    head, _, query = base.partition("?")
    return head, dict(sorted(parse_qsl(query, keep_blank_values=True))), "#" + rest if rest else ""


def with_query(head, values, tail=""):
    text = "&".join(f"{quote_plus(k)}={v if '{' in v and '}' in v else quote_plus(v)}" for k, v in sorted(values.items()))
    return head + ("?" + text if text else "") + tail


def actions_of(url, schema, page):
    out = [("navigate", "navigate", "http_get", "GET", "{url}", "html_page", 0.95, [("url", True)])]
    head, query, tail = parts(url)
    search = next((k for k in sorted(query) if searches(k)), None)
    paged = next((k for k in sorted(query) if token(k) in PAGE), None)
    if search:
        kept = {k: v for k, v in query.items() if k != paged or k == search}
        out.append(("search", "search", "http_get", "GET", with_query(head, {**kept, search: "{query}"}, tail), "url_pattern", 0.82, [("query", True)]))
        if paged:
            out.append(("paginate", "paginate", "http_get", "GET", with_query(head, {**query, paged: "{page}"}, tail), "url_pattern", 0.78, [("page", True)]))
    if schema:
        for name, method, template, sure, variables, params in schema[1]:
            name = "".join("_" if c in " -/" else c for c in name.strip().lower()).strip("_") or "api_call"
            out.append((name, "api_call", "api_call", method.upper(), template, "api_schema", sure, [(v[0], True) for v in variables] + [(p[0], p[2]) for p in params]))
        out += [(*a[:7], [(p[0], p[3]) for p in a[7]]) for a in schema[2]]
    if page:
        for action, method, fields in page[1]:
            found = next((f[0] for f in fields if f[1] != "hidden" and (f[1] == "search" or searches(f[0]))), None)
            sent = [f for f in fields if f[1] not in ("submit", "button", "image", "reset", "file")]
            visible = [f for f in fields if f[1] not in ("hidden", "submit", "button", "reset", "image")]
            post = method.upper() == "POST"
            if not sent or post and not visible:
                continue
            values = {f[0]: f[2] if f[1] in ("hidden", "select") and f[2] else "{" + f[0] + "}" for f in sent}
            h, _, t = parts(action)
            kind = "search" if found else "submit_form"
            out.append((kind, kind, "http_post_form" if post else "http_get", "POST" if post else "GET", action if post else with_query(h, values, t), "html_page", 0.9 if found else 0.75, [(f[0], f[3] or f[0] == found) for f in sent]))
        for text, href in page[0]:
            h, q, t = parts(href)
            last = h.rstrip("/").rpartition("/")[2]
            if (text.strip().lower() == "next" or "next page" in text.lower() or q.get("page") or "page" in last) and q.get("page"):
                out.append(("paginate", "paginate", "http_get", "GET", with_query(h, {**q, "page": "{page}"}, t), "html_page", 0.88, [("page", True)]))
                break
        else:
            if query.get("page"):
                out.append(("paginate", "paginate", "http_get", "GET", with_query(head, {**query, "page": "{page}"}, tail), "html_page", 0.7, [("page", True)]))
    return out


def rank(a):
    name, kind, transport, _, template, source, sure, params = a
    score = int(sure * 100) + {"api_call": 40, "http_get": 15}.get(transport, 0) + {"search": 30, "paginate": 20, "navigate": 5}.get(kind, 0) + {"api_schema": 20, "url_pattern": 15}.get(source, 0)
    score -= 4 * len(params) + 8 * (len(template) > 120) + 12 * sum(t in template for t in ["qid=", "ref=", "_trksid=", "anti-csrftoken", "offerListingId", "clientName"])
    for p, required in params:
        score += 18 * (token(p) in ("query", "q", "search", "keyword", "keywords", "term", "nkw")) - 8 * (token(p) in ("url", "ref", "qid")) - 2 * (not required)
    return score + 20 * ("{query}" in template or "{q}" in template) + 10 * (kind == "search" and len(params) == 1)


def catalog_of(url, schema, page):
    found = actions_of(url, schema, page)
    given = len(schema[1]) + len(schema[2]) if schema else 0
    out, seen, names = [], set(), {}
    for a in sorted(found, key=lambda a: (-rank(a), a[0], len(a[7]), a[4])):
        if (a[0], a[2], a[4]) in seen:
            continue
        seen.add((a[0], a[2], a[4]))
        names[a[0]] = names.get(a[0], 0) + 1
        out.append((a[0] if names[a[0]] == 1 else f"{a[0]}_{names[a[0]]}", *a[1:]))
    source = "html_extraction" if not schema else "hybrid" if len(out) > given else "api"
    return source, (schema and schema[0]) or "partial", out


def run(spark, targets, schemas, pages):
    df = ac.build_catalogs(
        spark.createDataFrame([(u,) for u in targets], "url string"),
        spark.createDataFrame([(u, s[0], s[1], [(*a[:7], a[7]) for a in s[2]]) for u, s in schemas.items()], SCHEMAS),
        spark.createDataFrame([(u, *p) for u, p in pages.items()], PAGES),
    )
    return {r.url: (r.source, r.coverage, [(*tuple(a)[:7], [(p.name, p.required) for p in a.params]) for a in r.actions]) for r in df.collect()}


def test_catalogs_are_what_a_direct_program_builds(spark):
    rng = random.Random(12)
    keys = ["q", "page", "sort", "Search Term", "pg", "ref", "a*b", "ü~x"]
    targets = [f"https://h{k}.com/p/{k}" + ("?" + "&".join(f"{quote_plus(x)}={quote_plus(rng.choice(['1', 'a b', 'é', '']))}" for x in rng.sample(keys, rng.randrange(4)))) * (k % 5 > 0) + "#top" * (k % 7 == 0) for k in range(120)]
    field = lambda: (rng.choice(["q", "name", "lang", "Keyword", "x y"]), rng.choice(["text", "hidden", "search", "select", "submit", "file", "checkbox"]), rng.choice(["", "v 1", None]), rng.random() < 0.5)
    def form():
        fields = {f[0]: f for f in (field() for _ in range(rng.randrange(5)))}
        return (rng.choice(["https://h.com/s", "https://h.com/s#f"]), rng.choice(["GET", "post", "POST"]), list(fields.values()))
    link = lambda: (rng.choice([" Next ", "go to next page", "about", "2"]), rng.choice(["https://h.com/list?page=2&z=1", "https://h.com/pages/2", "https://h.com/?page=", "https://h.com/page?page=4&page=4#x", "https://h.com/x"]))
    endpoint = lambda: (rng.choice(["List Items", "search", "", "a-b/c"]), rng.choice(["get", "POST"]), rng.choice(["https://api/x/{id}", "https://api/s?q={query}", "https://api/" + "y" * 130]), rng.choice([0.5, 0.9, 0.29]), [("id", "path")][: rng.randrange(2)], [("q", "1", False), ("ref", "", True)][: rng.randrange(3)])
    act = lambda: (rng.choice(["add_to_cart", "search"]), "api_call", "api_call", "POST", rng.choice(["/cart/add", "/cart/{id}"]), "shopify_ajax_api", 0.98, [("id", "body", "integer", True, None)])
    schemas = {u: (rng.choice(["", "complete", None]), [endpoint() for _ in range(rng.randrange(4))], [act() for _ in range(rng.randrange(3))]) for u in targets if rng.random() < 0.5}
    pages = {u: ([link() for _ in range(rng.randrange(4))], [form() for _ in range(rng.randrange(3))]) for u in targets if rng.random() < 0.7}
    found = run(spark, [*targets, targets[0]], schemas, pages)
    wanted = {u: catalog_of(u, schemas.get(u), pages.get(u)) for u in targets}
    for u in targets:
        assert found[u] == wanted[u], u
    assert {x[0] for x in found.values()} == {"html_extraction", "hybrid", "api"} and any(a[0].endswith("_2") for x in found.values() for a in x[2])


def test_repeats_of_an_api_schema_leave_it_an_api_catalog(spark):
    """Two equal endpoints beside navigate: two actions are left, as many as the schema gave, so nothing is added."""
    e = ("Get", "GET", "https://api/x", 0.9, [], [])
    found = run(spark, ["https://a.com/"], {"https://a.com/": ("complete", [e, e], [])}, {})
    assert found["https://a.com/"][:2] == ("api", "complete") and [a[0] for a in found["https://a.com/"][2]] == ["get", "navigate"]


@pytest.mark.parametrize(("url", "wanted"), [("https://a.com/s?b=2&a=x+y&page=3#f", "https://a.com/s?a=x+y&b=2&page={page}#f"), ("https://a.com/s?page=1", "https://a.com/s?page={page}")])
def test_templates(spark, url, wanted):
    assert spark.range(1).select(ac.with_query(F.lit(url), ac._set(ac.query_pairs(F.lit(url)), F.lit("page"), F.lit("{page}")))).first()[0] == wanted
