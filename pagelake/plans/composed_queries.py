"""Whole catalogs of actions, requests of endpoints, and templates that differ by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, row_templates, urls
from ..operators import action_catalog, catalog, documents, domain_rules, requests
from ..sources.tables import read_table
from . import views
from .page_queries import _UNESC
from .traffic_queries import _BARE, _NOSCRIPT
from .url_queries import _AUTH, _PATH, _segs, norm_sql

#: A target for each page, with or without a query; both engines run it. n is the least page of a url.
_TARGET = """
concat(regexp_replace(url, '[?#].*$', ''), CASE page_id % 4 WHEN 0 THEN concat('?page=2&q=x', page_id % 8, '&z=1') WHEN 1 THEN '?page=3' WHEN 2 THEN '?lang=en&keyword=a+b' ELSE '' END)"""
_FIELD = "named_struct('name', '{}', 'type', '{}', 'value', '{}', 'required', false)"
_LINKS = """CASE n % 5 WHEN 1 THEN array(named_struct('text', 'Next', 'href', 'https://l.example/list?b=1&page=7')) WHEN 2 THEN array(named_struct('text', 'about', 'href', '/x'))
  ELSE CAST(array() AS array<struct<text:string,href:string>>) END"""
_FORMS = f"""CASE n % 6 WHEN 0 THEN array(named_struct('action', 'https://f.example/s', 'method', 'GET', 'fields', array({_FIELD.format("q", "search", "")}, {_FIELD.format("lang", "hidden", "en")})))
  WHEN 1 THEN array(named_struct('action', 'https://f.example/p', 'method', 'POST', 'fields', array({_FIELD.format("name", "text", "")}, {_FIELD.format("go", "submit", "")}))) END"""
_ENDPOINT = "named_struct('name', 'List Items', 'method', 'get', 'url_template', 'https://api.example/items/{id}', 'confidence', 0.9D, 'variables', array(named_struct('name', 'id', 'source', 'path')), 'query_params', CAST(array() AS array<struct<key:string,value:string,required:boolean>>))"
_DECLARED = """named_struct('name', 'add_to_cart', 'kind', 'api_call', 'transport', 'api_call', 'method', 'POST', 'url_template', '/cart/add.js', 'source', 'shopify_ajax_api', 'confidence', 0.98D,
  'params', array(named_struct('name', 'id', 'place', 'body', 'type', 'integer', 'required', true, 'default', CAST(NULL AS string))))"""


def action_catalogs(spark, d):
    """The catalog of every page's target: schemas for a third of them, captured pages for four fifths."""
    targets = read_table(spark, d, "pages").withColumn("url", F.expr(_TARGET)).groupBy("url").agg(F.min("page_id").alias("n"))
    schemas = targets.filter("n % 3 = 0").selectExpr(
        "url", "CASE WHEN n % 2 = 0 THEN 'complete' ELSE '' END AS coverage", f"CASE WHEN n % 2 = 0 THEN array({_ENDPOINT}, {_ENDPOINT}) ELSE array({_ENDPOINT}) END AS endpoints",
        f"CASE WHEN n % 9 = 0 THEN array({_DECLARED}) END AS actions",
    )
    pages = targets.filter("n % 5 <> 0").selectExpr("url", f"{_LINKS} AS links", f"{_FORMS} AS forms")
    found = action_catalog.build_catalogs(targets, schemas, pages)
    shown = F.transform("actions", lambda a: F.concat_ws("|", a["name"], a["kind"], a["transport"], a["method"], a["url_template"], a["source"]))
    return found.select("domain", "url", "source", "coverage", F.size("actions").cast("bigint").alias("n_actions"), F.array_join(shown, "\n").alias("actions"))


#: A JSON template for each captured entry; both engines run it.
_TEMPLATE = """CASE ord % 5 WHEN 0 THEN '{"id":{{id}},"name":"{{ name }}"}' WHEN 1 THEN '{"name":{{name|json}},"none":"{{none}}"}' WHEN 2 THEN '[{{list|json_array}}]'
  WHEN 3 THEN '{{id|text}}' ELSE '{"id":{{id}' END"""


def templates_by_row(spark, d):
    rows = views.har(spark, d).withColumn("template", F.expr(_TEMPLATE))
    values = F.create_map(F.lit("id"), F.col("ord").cast("string"), F.lit("name"), F.concat("event_type", F.lit(' "<x>"')), F.lit("list"), F.concat_ws(", ", F.col("ord").cast("string"), "event_type", F.lit("")))
    return rows.select("ord", row_templates.render_json(F.col("template"), values).alias("rendered"))


def endpoint_scan(spark, d):
    """Every page's URL as the target of its domain's two endpoints, with the responses that were captured for a part of them."""
    pages = read_table(spark, d, "pages").select("page_id", "url", urls.authority(F.col("url")).alias("domain"), urls.segments(urls.path(F.col("url"))).alias("seg"))
    both = "array(named_struct('name', 'lang', 'source', 'path', 'pattern', '0'), named_struct('name', 'id', 'source', 'path', 'pattern', '^[0-9]+$'))"
    endpoints = pages.select("domain").distinct().selectExpr(
        "domain", "inline(array(named_struct('name', 'get', 'method', 'get', 'url_template', concat('https://api.', domain, '/{lang}/{id}'), 'body_template', CAST(NULL AS string)), "
        "named_struct('name', 'post', 'method', 'POST', 'url_template', concat('https://api.', domain, '/q'), 'body_template', '{\"id\":\"{id}\"}')))",
    ).withColumns({"variables": F.expr(both), "headers": F.lit(None).cast("map<string,string>"), "content_type": F.lit("application/json")})
    answers = pages.filter("page_id % 3 < 2").select(
        F.col("page_id").alias("ord"), F.lit("GET").alias("method"), F.concat(F.lit("https://api."), "domain", F.lit("/"), F.array_join("seg", "/")).alias("url"), F.lit(None).cast("string").alias("request_body"),
        F.when(F.col("page_id") % 3 == 0, 200).otherwise(503).alias("status"), F.concat(F.lit('{"p":'), F.col("page_id").cast("string"), F.lit("}")).alias("body"),
    )
    targets = pages.select("domain", "url").distinct().withColumn("overrides", F.lit(None).cast("map<string,string>"))
    return requests.scan_endpoints(targets, endpoints, answers).select("url", "name", "method", "request_url", "body", F.col("headers")["Content-Type"].alias("content_type"), "outcome", "status", "data")


#: Bytes of a document, so few that most captures are over it.
DOCUMENT_BYTES = 3000


def traffic_documents_budget(spark, d):
    """A document under a budget for each capture; its DOM is that of nobody, its url the least of its entries."""
    rows = views.har(spark, d).withColumn("req_headers", F.create_map(F.lit("Accept"), F.lit("*/*"), F.lit("X-Type"), F.col("event_type")))
    captures = rows.groupBy("capture_id").agg(F.min("url").alias("url")).withColumn("dom", F.lit(None).cast("string"))
    found = documents.traffic_documents(captures, rows, DOCUMENT_BYTES)
    return found.select("capture_id", F.sha2("document", 256).alias("document_sha256"), "n_sections", "n_left_out", "n_bytes")


def page_documents(spark, d):
    found = documents.page_documents(read_table(spark, d, "pages"), DOCUMENT_BYTES)
    return found.select("page_id", F.sha2("document", 256).alias("document_sha256"), F.octet_length("document").cast("bigint").alias("n_bytes"))


def rules_by_domain(spark, d):
    """Answers of two versions for a part of the domains, no rules for another, applied to all pages."""
    pages = read_table(spark, d, "pages")
    domains = pages.select(urls.bare_host(F.col("url")).alias("domain")).distinct().withColumn("k", F.length("domain") % 4).filter("k > 0")
    lang, heading = (f'Rules: {{"page_type":"{t}","entity_fields":[{{"name":"{n}","selector":"{c}","attribute":"{a}"}}]}}' for t, n, c, a in (("a", "lang", "html", "lang"), ("b", "heading", "h1", "")))
    newest = F.when(F.col("k") == 1, F.lit(lang)).when(F.col("k") == 2, F.lit(heading)).otherwise(F.lit("I cannot help with that"))
    answers = domains.select("domain", F.lit(2).alias("version"), F.lit("2024-01-02").alias("answered_at"), newest.alias("answer"))
    older = domains.select("domain", F.lit(1).alias("version"), F.lit("2024-01-03").alias("answered_at"), F.lit("{}").alias("answer"))
    found = domain_rules.extract_by_domain(pages, answers.unionByName(older))
    value = lambda name: F.get_json_object("data", f"$.{name}").alias(name)
    return found.select("page_id", "domain", "rules_version", "status", value("type"), value("title"), value("lang"), value("heading"))


#: What the texts of two queries are made of; both engines run them.
_CODED = "concat(event_type, '?', props, repeat('ÿ', CAST(event_id % 4 AS INT)))"
_ENVELOPE = """CASE event_id % 4 WHEN 0 THEN concat('{"success":true,"data":', props, '}') WHEN 1 THEN concat('{"success":false,"error":{"code":"', event_type, '"}}')
  WHEN 2 THEN '{"data":1}' ELSE '<html>' END"""


def text_codecs(spark, d):
    text = F.expr(_CODED)
    rows = read_table(spark, d, "events").select("event_id", text.alias("text"))
    return rows.select(
        "event_id", codecs.sha1_hex(F.col("text")).alias("sha1"), codecs.base64_text(F.col("text")).alias("base64"), codecs.base64_url(F.col("text")).alias("base64_url"),
        (codecs.from_base64(codecs.base64_url(F.col("text"))) == F.col("text")).alias("comes_back"), codecs.from_hex(codecs.hex_text(F.col("text"))).alias("from_hex"), codecs.from_base64(F.concat("text", F.lit("*"))).alias("none"),
    )


def registry_envelopes(spark, d):
    return read_table(spark, d, "events").select("event_id", codecs.unwrapped(F.expr(_ENVELOPE)).alias("e")).select("event_id", "e.ok", F.get_json_object("e.data", "$.k").alias("k"), "e.code", "e.message")


def schema_classes(spark, d):
    """Schemas of all types, and of none, by order."""
    kind = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'css' WHEN 2 THEN '' END")
    rules = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '{\"strategy\":\"next_data\"}' WHEN 1 THEN '{\"title_selector\":\"h1\"}' END")
    return read_table(spark, d, "orders").select("o_orderkey", catalog.schema_class(kind, F.col("o_orderkey") % 2, rules).alias("class"))


#: Known sites of the pages' hosts: host, path, template, and where its id comes from.
_RULES = [(1, "net", r"\.example\.net$", r"^/(en|de)/", "https://net.example/api/{id}"), (2, "com", r"example\.com$", r"^/[a-z]{2}/[0-9]+/?$", "https://com.example/{id}.json"), (3, "any", ".", r"\.html$", "https://any.example/{id}")]
_ID = r"^[0-9]+(?:\.html)?$"


def probe_candidates_all(spark, d):
    """The candidates of all five strategies for every page, known sites and stores among them, in one ranking."""
    sites = spark.createDataFrame([(*r, [("id", "path", _ID)]) for r in _RULES], f"ord int, site string, host_pattern string, path_pattern string, api_template string, variables {row_templates.VARIABLES}")
    asked = catalog.all_probe_candidates(read_table(spark, d, "pages").select("page_id", "url"), sites)
    scored = asked.withColumn("score", catalog.probe_score(F.col("strategy"), F.col("pattern"), F.col("has_headers"))).withColumns({"method": F.lit("GET"), "url_template": F.col("probe_url")})
    return catalog.rank_candidates(scored).select("page_id", "strategy", "probe_url", "score", F.col("rank").cast("int").alias("rank"))


QUERIES = {"probe_candidates_all": probe_candidates_all, "text_codecs": text_codecs, "registry_envelopes": registry_envelopes, "schema_classes": schema_classes, "rules_by_domain": rules_by_domain, "traffic_documents_budget": traffic_documents_budget, "page_documents": page_documents, "action_catalogs": action_catalogs, "templates_by_row": templates_by_row, "endpoint_scan": endpoint_scan}
ORACLE_SQL = {
    "action_catalogs": f"""
WITH t AS (SELECT url, min(page_id) AS n FROM (SELECT page_id, {_TARGET} AS url FROM pages) GROUP BY url),
b AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS base, 'x' || (regexp_extract(url, 'q=x([0-9]+)', 1)) AS q FROM t),
own AS (SELECT url, n, CASE WHEN contains(url, '?page=2') THEN base || '?page={{page}}&q=' || q || '&z=1' WHEN contains(url, '?page=3') THEN base || '?page={{page}}' END AS paged FROM b),
a AS (
  SELECT url, 0 AS section, 'navigate' AS name, 'navigate' AS kind, 'http_get' AS transport, 'GET' AS method, '{{url}}' AS tmpl, 'html_page' AS source, 95 AS conf, 1 AS np, 0 AS ns, 1 AS nb, 0 AS no FROM b
  UNION ALL SELECT url, 1, 'search', 'search', 'http_get', 'GET', base || CASE WHEN contains(url, '?page=2') THEN '?q={{query}}&z=1' ELSE '?keyword={{query}}&lang=en' END, 'url_pattern', 82, 1, 1, 0, 0
    FROM b WHERE contains(url, '?page=2') OR contains(url, '?lang=en')
  UNION ALL SELECT url, 1, 'paginate', 'paginate', 'http_get', 'GET', paged, 'url_pattern', 78, 1, 0, 0, 0 FROM own WHERE contains(url, '?page=2')
  UNION ALL SELECT url, 2, 'list_items', 'api_call', 'api_call', 'GET', 'https://api.example/items/{{id}}', 'api_schema', 90, 1, 0, 0, 0 FROM b WHERE n % 3 = 0
  UNION ALL SELECT url, 3, 'add_to_cart', 'api_call', 'api_call', 'POST', '/cart/add.js', 'shopify_ajax_api', 98, 1, 0, 0, 0 FROM b WHERE n % 9 = 0
  UNION ALL SELECT url, 4, 'search', 'search', 'http_get', 'GET', 'https://f.example/s?lang=en&q={{q}}', 'html_page', 90, 2, 1, 0, 1 FROM b WHERE n % 5 <> 0 AND n % 6 = 0
  UNION ALL SELECT url, 4, 'submit_form', 'submit_form', 'http_post_form', 'POST', 'https://f.example/p', 'html_page', 75, 1, 0, 0, 1 FROM b WHERE n % 5 <> 0 AND n % 6 = 1
  UNION ALL SELECT url, 5, 'paginate', 'paginate', 'http_get', 'GET', CASE WHEN n % 5 = 1 THEN 'https://l.example/list?b=1&page={{page}}' ELSE paged END, 'html_page', CASE WHEN n % 5 = 1 THEN 88 ELSE 70 END, 1, 0, 0, 0
    FROM own WHERE n % 5 <> 0 AND (n % 5 = 1 OR paged IS NOT NULL)
), r AS (
  SELECT *, conf + CASE transport WHEN 'api_call' THEN 40 WHEN 'http_get' THEN 15 ELSE 0 END + CASE kind WHEN 'search' THEN 30 WHEN 'paginate' THEN 20 WHEN 'navigate' THEN 5 ELSE 0 END
    + CASE source WHEN 'api_schema' THEN 20 WHEN 'url_pattern' THEN 15 ELSE 0 END - 4 * np + 18 * ns - 8 * nb - 2 * no - CASE WHEN strlen(tmpl) > 120 THEN 8 ELSE 0 END
    + CASE WHEN contains(tmpl, '{{query}}') OR contains(tmpl, '{{q}}') THEN 20 ELSE 0 END + CASE WHEN kind = 'search' AND np = 1 THEN 10 ELSE 0 END AS rank FROM a
), u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY url, name, transport, tmpl ORDER BY rank DESC, np, section) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY url, name ORDER BY rank DESC, np, tmpl, section) AS k FROM u),
g AS (
  SELECT url, count(*) AS n_actions, string_agg(name || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '|' || kind || '|' || transport || '|' || method || '|' || tmpl || '|' || source, chr(10) ORDER BY rank DESC, name, np, tmpl, section) AS actions
  FROM v GROUP BY url
)
SELECT {_AUTH.replace("url", "g.url")} AS domain, g.url, CASE WHEN n % 3 <> 0 THEN 'html_extraction' WHEN n_actions > 1 + (n % 2 = 0)::INT + (n % 9 = 0)::INT THEN 'hybrid' ELSE 'api' END AS source,
  CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'complete' ELSE 'partial' END AS coverage, n_actions, actions FROM g JOIN t ON g.url = t.url""",
    "traffic_documents_budget": f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ord) AS n FROM ({views.har_sql()})),
s AS (
  SELECT capture_id, 0 AS n, '# URL' || chr(10) || min(url) || chr(10) || '# DOM' || chr(10) AS t FROM e GROUP BY capture_id UNION ALL
  SELECT capture_id, n, concat_ws(chr(10), '## ' || n || '. ' || method || ' ' || url, 'status ' || status, 'type ' || content_type, 'bytes ' || strlen(body), 'header Accept: */*' || chr(10) || 'header X-Type: ' || event_type, body) FROM e
), w AS (SELECT *, strlen(t) + CASE WHEN n > 0 THEN 2 ELSE 0 END AS size, sum(strlen(t) + CASE WHEN n > 0 THEN 2 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n) AS upto FROM s),
c AS (
  SELECT capture_id, n, CASE WHEN upto <= {DOCUMENT_BYTES} THEN t WHEN {DOCUMENT_BYTES} - (upto - size) - 2 - 6 > 0 THEN t[1:{DOCUMENT_BYTES} - (upto - size) - 2 - 6] || chr(10) || '[cut]' END AS t FROM w
), g AS (SELECT capture_id, string_agg(t, chr(10) || chr(10) ORDER BY n) AS doc, count(t) AS k, count(*) AS a FROM c GROUP BY capture_id)
SELECT capture_id, sha256(doc) AS document_sha256, k AS n_sections, a - k AS n_left_out, CAST(strlen(doc) AS BIGINT) AS n_bytes FROM g""",
    "page_documents": f"""
WITH h AS (SELECT page_id, coalesce(url, '') AS url, {_NOSCRIPT.replace("html", "coalesce(html, '')")} AS h FROM pages),
b AS (SELECT *, list_max(list_filter(generate_series(1, {DOCUMENT_BYTES}), lambda k: strlen(h[1:k]) <= {DOCUMENT_BYTES} - 6)) AS k FROM h),
d AS (SELECT page_id, '# URL' || chr(10) || url || chr(10) || '# HTML' || chr(10) || CASE WHEN strlen(h) <= {DOCUMENT_BYTES} THEN h ELSE h[1:k] || chr(10) || '[cut]' END AS doc FROM b)
SELECT page_id, sha256(doc) AS document_sha256, CAST(strlen(doc) AS BIGINT) AS n_bytes FROM d""",
    "rules_by_domain": f"""
WITH p AS (SELECT page_id, {_BARE} AS domain, trim({_UNESC("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}) AS h1, trim({_UNESC("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS head, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages),
k AS (SELECT *, length(domain) % 4 AS k FROM p)
SELECT page_id, domain, CASE WHEN k > 0 THEN 2 END AS rules_version, CASE k WHEN 0 THEN 'no_rules' WHEN 3 THEN 'invalid' ELSE 'ok' END AS status, CASE k WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS type,
  CASE WHEN k IN (1, 2) THEN coalesce(nullif(h1, ''), head) END AS title, CASE WHEN k = 1 THEN nullif(lang, '') END AS lang, CASE WHEN k = 2 THEN nullif(h1, '') END AS heading FROM k""",
    "probe_candidates_all": rf"""
WITH p AS (SELECT page_id, url, {_AUTH} AS host, {_PATH} AS path, {_segs(_PATH)} AS seg, CASE WHEN contains({norm_sql(_PATH)}, '{{}}') THEN 10 ELSE 0 END AS more FROM pages),
q AS (
  SELECT *, list_filter(seg, lambda s: regexp_matches(s, '{_ID}'))[-1] AS id, CASE WHEN regexp_matches(host, '\.example\.net$') AND regexp_matches(path, '^/(en|de)/') THEN 'https://net.example/api/'
    WHEN regexp_matches(host, 'example\.com$') AND regexp_matches(path, '^/[a-z]{{2}}/[0-9]+/?$') THEN 'https://com.example/' WHEN regexp_matches(path, '\.html$') THEN 'https://any.example/' END AS api FROM p
), c AS (
  SELECT page_id, url, 'json_suffix' AS strategy, rtrim(regexp_replace(url, '[?#].*$', ''), '/') || '.json' AS probe_url, 120 + more AS score FROM q UNION ALL
  SELECT page_id, url, 'accept_header', url, 75 + more FROM q UNION ALL
  SELECT page_id, url, 'wp_json', regexp_extract(url, '^[A-Za-z]+://', 0) || host || '/wp-json/wp/v2/posts?slug=' || coalesce(list_last(seg), ''), 20 + more FROM q UNION ALL
  SELECT page_id, url, 'known_site', api || id || CASE WHEN contains(api, 'com.example') THEN '.json' ELSE '' END, 140 + more FROM q WHERE api IS NOT NULL AND id IS NOT NULL UNION ALL
  SELECT page_id, url, 'shopify', regexp_extract(url, '^[A-Za-z]+://', 0) || host || '/products.json', 130 FROM q
), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url, probe_url ORDER BY score DESC, strategy) = 1)
SELECT page_id, strategy, probe_url, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY url ORDER BY score DESC, strategy) AS INTEGER) AS rank FROM f""",
    "text_codecs": f"""
SELECT event_id, sha1(t) AS sha1, base64(encode(t)) AS base64, rtrim(translate(base64(encode(t)), '+/', '-_'), '=') AS base64_url, true AS comes_back, t AS from_hex, NULL AS none
FROM (SELECT event_id, {_CODED.replace("ÿ', CAST(event_id % 4 AS INT)", "ÿ', event_id % 4")} AS t FROM events)""",
    "registry_envelopes": """
SELECT event_id, event_id % 4 = 0 AS ok, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_type ELSE '' END AS code,
  CASE WHEN event_id % 4 > 0 THEN '' END AS message FROM events""",
    "schema_classes": """
SELECT o_orderkey, CASE WHEN k = 1 OR (k >= 2 AND r < 2) THEN CASE WHEN r = 0 THEN 'next_data' ELSE 'css' END WHEN k = 0 OR e > 0 THEN 'api' ELSE 'other' END AS class
FROM (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderkey % 3 AS r, o_orderkey % 2 AS e FROM orders)""",
    "templates_by_row": rf"""
SELECT ord, CASE ord % 5 WHEN 0 THEN '{{"id":' || ord || ',"name":"' || event_type || ' \"\u003cx\u003e\""}}' WHEN 1 THEN '{{"name":"' || event_type || ' \"\u003cx\u003e\"","none":""}}'
  WHEN 2 THEN '["' || ord || '","' || event_type || '",""]' END AS rendered FROM ({views.har_sql()})""",
    "endpoint_scan": f"""
WITH p AS (SELECT page_id, url, {_AUTH} AS domain, {_segs(_PATH)} AS seg FROM pages),
t AS (SELECT DISTINCT url, domain, seg, list_filter(seg, lambda s: regexp_matches(s, '^[0-9]+$'))[-1] AS id FROM p),
q AS (
  SELECT url, 'get' AS name, 'GET' AS method, CASE WHEN id IS NOT NULL THEN 'https://api.' || domain || '/' || seg[1] || '/' || id END AS request_url, NULL AS body FROM t UNION ALL
  SELECT url, 'post', 'POST', CASE WHEN id IS NOT NULL THEN 'https://api.' || domain || '/q' END, '{{"id":"' || id || '"}}' FROM t
), r AS (SELECT 'https://api.' || domain || '/' || array_to_string(seg, '/') AS url, max(page_id) AS page_id FROM p WHERE page_id % 3 < 2 GROUP BY 1)
SELECT q.url, name, method, request_url, body, 'application/json' AS content_type,
  CASE WHEN request_url IS NULL THEN 'unresolved' WHEN page_id IS NULL THEN 'missing' WHEN page_id % 3 = 0 THEN 'ok' ELSE 'transient' END AS outcome,
  CASE WHEN page_id % 3 = 0 THEN 200 WHEN page_id IS NOT NULL THEN 503 END AS status, CASE WHEN page_id % 3 = 0 THEN '{{"p":' || page_id || '}}' END AS data
FROM q LEFT JOIN r ON q.method = 'GET' AND q.request_url = r.url""",
}
