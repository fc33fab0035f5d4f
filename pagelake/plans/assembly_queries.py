"""Known sites, stores, catalogs, registry lists, and outputs of pages and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, extract
from ..sources.tables import read_table

#: URLs of events, by event_id % 6; both engines run this text.
_URLS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('https://www.code.example/u', user_id, '/r', event_id)
  WHEN 1 THEN concat('https://www.code.example/u', user_id, '/r', event_id, '/tree/main/a/b', event_id) WHEN 2 THEN concat('https://items.example/item?id=', event_id, '&id=9&x=%20')
  WHEN 3 THEN 'https://items.example/none' WHEN 4 THEN concat('https://code.example/a/', event_id) ELSE concat('https://www.code.example/', event_id) END AS url FROM {events}"""
_SITES = [
    (0, "github_repo", r"^(?P<sub>[a-z]+)\.code\.example$", "^/(?P<owner>[^/]+)/(?P<repo>[^/]+)$", "https://api.example/{sub}/{owner}/{repo}", [("owner", "path", "0"), ("repo", "path", "^r[0-9]+$")]),
    (1, "github_tree", r"\.code\.example$", "^/[^/]+/[^/]+/tree/", "https://api.example/{owner}/{repo}/in/{path}?ref={ref}", [("owner", "path", "0"), ("repo", "path", "1"), ("path", "path_rest", "4")]),
    (2, "hn_item", r"^items\.example$", "^/item$", "https://api.example/{id}.json", [("id", "query", "")]),
    (3, "other", r"^www\.code\.example$", "^/", "https://other.example/{x}", []),
]


def _targets(spark, d):
    return spark.sql(_URLS, events=read_table(spark, d, "events"))


def known_site_schemas(spark, d):
    """The first site's API answers for every third event only; a later site takes what is left, or none does."""
    kinds = "ord int, name string, host_pattern string, path_pattern string, api_url_template string, variables array<struct<name:string,source:string,pattern:string>>"
    targets = _targets(spark, d)
    repo = F.concat(F.lit("https://api.example/www"), F.regexp_extract("url", r"example(/u[0-9]+/r[0-9]+)$", 1))
    tree = F.regexp_replace("url", r"^https://www\.code\.example/(u\d+)/(r\d+)/tree/main/(.*)$", r"https://api.example/$1/$2/in/$3?ref={ref}")
    item = F.concat(F.lit("https://api.example/"), F.col("event_id").cast("string"), F.lit(".json"))
    answers = targets.filter("event_id % 9 < 6").select(F.when(F.col("event_id") % 6 == 0, repo).when(F.col("event_id") % 6 == 1, tree).otherwise(item).alias("api_url"))
    answers = answers.unionByName(targets.sparkSession.createDataFrame([("https://other.example/{x}",)], "api_url string"))
    return assembly.known_site_schemas(targets, spark.createDataFrame(_SITES, kinds), answers).select(
        "url", "domain", "id", "url_pattern", "strategy", "description", "url_template", "api_url", "confidence"
    )


_HOST = "concat('https://s', c_custkey, '.shop.example')"


def store_schemas(spark, d):
    rows = read_table(spark, d, "customer").selectExpr(
        f"concat({_HOST}, '/p/', c_custkey, '?x') AS url", f"concat({_HOST}, '/products.json') AS probe",
        """CASE c_custkey % 4 WHEN 0 THEN '{"products":[]}' WHEN 1 THEN '{"products":{}}' WHEN 2 THEN '{"products":[' ELSE concat('{"products":[{"id":', c_custkey, '}]}') END AS body""",
    )
    found = assembly.store_schemas(rows.select("url"), rows.select(F.col("probe").alias("url"), "body"))
    return found.select("url", "domain", "id", "coverage", "name", "url_template", "is_primary", "confidence")


def store_actions(spark, d):
    found = assembly.store_actions(read_table(spark, d, "customer").selectExpr(f"concat({_HOST}, '/p/', c_custkey) AS url"))
    return found.select("url", "name", "method", "url_template", F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",").alias("params"))


_ACTIONS = """SELECT concat('https://h', c_custkey, '.example/') AS url, concat('a', i) AS name, 'api_call' AS kind, 'api_call' AS transport, concat('/', i) AS url_template,
  CASE WHEN i = 2 THEN 'url' ELSE 'api_schema' END AS source, 0.5 AS confidence FROM {customer} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2)
WHERE (i < 2 AND c_custkey % 4 > 0 AND c_custkey % 3 > i) OR (i = 2 AND c_custkey % 5 > 1)"""


def catalogs(spark, d):
    customer = read_table(spark, d, "customer")
    coverage = F.when(F.col("c_custkey") % 4 == 1, "").when(F.col("c_custkey") % 4 == 2, "complete").when(F.col("c_custkey") % 4 == 3, "partial")
    targets = customer.select(F.concat(F.lit("https://h"), F.col("c_custkey").cast("string"), F.lit(".example/")).alias("url"), coverage.alias("api_coverage"))
    found = assembly.assemble_catalogs(targets, spark.sql(_ACTIONS, customer=customer))
    return found.select("domain", "url", "source", "coverage", F.array_join(F.transform("actions", lambda a: a["name"]), ",").alias("names"))


def registry_listed(spark, d):
    rows = read_table(spark, d, "part").select(
        F.col("p_name").alias("site"), F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")).alias("intent_category"),
        F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 1 + F.col("p_size") % 32).alias("version_hash"), F.col("p_size").alias("popularity"),
    )
    return assembly.registry_list(rows, "c1", "E", "trending")


def dashboard_urls(spark, d):
    start = F.element_at(F.array(*map(F.lit, ["https://api.", "https://", "http://api.", "https://api.api."])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    url = F.concat(start, F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 0, ".example//").otherwise(".example"))
    return read_table(spark, d, "nation").select("n_nationkey", assembly.dashboard_url(url).alias("dashboard"))


def page_patterns(spark, d):
    state = F.format_string('<script id="__NEXT_DATA__" type="application/json">{"page":%s,"props":"some server state of this page"}</script>', F.col("page_id"))
    window = F.format_string('<script>window.__INITIAL_STATE__ = {"user":%s,"list":[1,2,3,4,5,6,7,8,9,10]};</script>', F.col("page_id"))
    shown = F.concat(F.when(F.col("page_id") % 3 == 0, state).otherwise(""), F.when(F.col("page_id") % 2 == 0, window).otherwise(""), F.col("html"))
    found = extract.extract_pages(read_table(spark, d, "pages").withColumn("html", shown), ("embedded_scripts", "next_data"))
    kept = assembly.patterns_map(F.col("embedded_scripts"), F.col("next_data"))
    return found.select("page_id", F.get_json_object(kept["__NEXT_DATA__"], "$.page").alias("next_page"), F.get_json_object(kept["__INITIAL_STATE__"], "$.user").alias("user"), F.size(kept).alias("n"))


def probe_outputs(spark, d):
    customer = read_table(spark, d, "customer").withColumn("url", F.concat(F.lit("u"), F.col("c_custkey").cast("string")))
    probes = customer.select("url", F.when(F.col("c_custkey") % 2 == 0, "json_suffix").otherwise("").alias("strategy"), (F.col("c_custkey") % 3 == 0).alias("requires_stealth"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("html"))
    rows = customer.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int")))).filter("i > 0")
    made = rows.select("url", F.concat(F.lit("s"), F.col("i").cast("string")).alias("strategy"), (F.col("i") * 10).alias("score"), F.when(F.col("i") == 1, "id").alias("schema_id"), F.when(F.col("i") == 1, 1).alias("endpoint_count"), F.lit(None).cast("string").alias("url_template"))
    return assembly.probe_outputs(probes, made)


def schema_round_trip(spark, d):
    made = read_table(spark, d, "customer").select("c_custkey", F.from_json(F.to_json(F.struct(
        F.col("c_name").alias("id"), F.lit("d").alias("domain"), (F.col("c_custkey") % 5).cast("int").alias("version"),
        F.array(F.struct(F.col("c_mktsegment").alias("name"), F.create_map(F.lit("h"), F.col("c_name")).alias("headers"), (F.col("c_custkey") / 8).alias("confidence"))).alias("endpoints"),
    )), assembly.SITE_SCHEMA).alias("s"))
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("[1]")).otherwise(assembly.schema_to_json(F.col("s")))
    back = made.select("c_custkey", assembly.schema_from_json(text).alias("s"))
    return back.select("c_custkey", "s.id", "s.version", F.col("s.endpoints")[0]["name"].alias("name"), F.col("s.endpoints")[0]["headers"]["h"].alias("phone"), F.col("s.endpoints")[0]["confidence"].alias("confidence"))


def previews(spark, d):
    size = (F.col("event_id") % 130).cast("int")
    made = F.format_string('{"t":"%s","a":%s}', F.repeat(F.lit("x"), size), F.col("event_id"))
    plain = F.repeat(F.lit("y"), (F.col("event_id") % 30 * 100).cast("int"))
    return read_table(spark, d, "events").select("event_id", assembly.preview(F.when(F.col("event_id") % 3 > 0, made).otherwise(plain)).alias("preview"))


def dom_snapshots(spark, d):
    deep = F.concat(F.repeat(F.lit("<div>"), (F.col("page_id") % 8).cast("int")), F.lit("deep"), F.repeat(F.lit("</div>"), (F.col("page_id") % 8).cast("int")))
    html = F.concat(F.lit("<title>t</title><body> a <p> x"), F.col("page_id").cast("string"), F.lit(" </p><script>1</script><b> </b>"), deep)
    return assembly.dom_snapshots(read_table(spark, d, "pages").withColumn("html", html)).select("page_id", "snapshot")


def pattern_catalogue(spark, d):
    return assembly.pattern_counts(read_table(spark, d, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        known_site_schemas, store_schemas, store_actions, catalogs, registry_listed, dashboard_urls, page_patterns, probe_outputs, schema_round_trip, previews, dom_snapshots, pattern_catalogue,
    )
}

_U = _URLS.replace("{events}", "events")
_REPO, _TREE = r"'^https://www\.code\.example/(u\d+)/(r\d+)$'", r"'^https://www\.code\.example/(u\d+)/(r\d+)/tree/main/(.*)$'"
_DESCRIBED = "CASE site " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in assembly.SITE_DESCRIPTIONS.items()) + f" ELSE '{assembly.SITE_DESCRIPTION}' END"
_NL = "chr(10)"

ORACLE_SQL = {
    "known_site_schemas": f"""
WITH u AS ({_U}), t AS (SELECT url, min(event_id) AS event_id FROM u GROUP BY url),
s AS (SELECT *, event_id % 6 AS m, CASE WHEN event_id % 6 < 3 AND event_id % 9 < 6 THEN ['github_repo', 'github_tree', 'hn_item'][event_id % 6 + 1] WHEN event_id % 6 IN (0, 1, 5) THEN 'other' END AS site FROM t)
SELECT url, d AS domain, substring(sha256(d || ':' || p), 1, 16) AS id, p AS url_pattern, 'known_site:' || site AS strategy, {_DESCRIBED} AS description,
  CASE site WHEN 'github_repo' THEN 'https://api.example/www/{{owner}}/{{repo}}' WHEN 'github_tree' THEN 'https://api.example/{{owner}}/{{repo}}/in/{{path}}?ref={{ref}}'
    WHEN 'hn_item' THEN 'https://api.example/{{id}}.json' ELSE 'https://other.example/{{x}}' END AS url_template,
  CASE site WHEN 'github_repo' THEN regexp_replace(url, {_REPO}, 'https://api.example/www/\\1/\\2') WHEN 'github_tree' THEN regexp_replace(url, {_TREE}, 'https://api.example/\\1/\\2/in/\\3?ref={{ref}}')
    WHEN 'hn_item' THEN 'https://api.example/' || event_id || '.json' ELSE 'https://other.example/{{x}}' END AS api_url, 0.98::DOUBLE AS confidence
FROM (SELECT *, CASE WHEN m = 2 THEN 'items.example' ELSE 'www.code.example' END AS d, CASE site WHEN 'github_repo' THEN '/{{}}/{{}}' WHEN 'github_tree' THEN '/{{}}/{{}}/tree/main/{{}}/{{}}' WHEN 'hn_item' THEN '/item'
  ELSE CASE m WHEN 5 THEN '/{{}}' ELSE regexp_replace(url, '^https://www.code.example', '') END END AS p FROM s WHERE site IS NOT NULL)""",
    "store_schemas": f"""
SELECT concat({_HOST}, '/p/', c_custkey, '?x') AS url, substring({_HOST}, 9) AS domain, substring(sha256(substring({_HOST}, 9) || ':/products'), 1, 16) AS id, 'complete' AS coverage,
  name, {_HOST} || path AS url_template, is_primary, confidence::DOUBLE AS confidence
FROM customer, (VALUES ('shopify_products', '/products.json', true, 0.98), ('shopify_product', '/products/{{handle}}.json', false, 0.95)) e(name, path, is_primary, confidence) WHERE c_custkey % 4 IN (0, 3)""",
    "store_actions": f"""
SELECT concat({_HOST}, '/p/', c_custkey) AS url, name, method, {_HOST} || path AS url_template, params
FROM customer, (VALUES ('add_to_cart', 'POST', '/cart/add.js', 'id:integer,quantity:integer'), ('get_cart', 'GET', '/cart.js', ''), ('update_cart', 'POST', '/cart/update.js', 'updates:object'),
  ('change_cart_item', 'POST', '/cart/change.js', 'id:string,quantity:integer')) a(name, method, path, params)""",
    "catalogs": f"""
WITH a AS ({_ACTIONS.replace("{customer}", "customer")}), g AS (SELECT url, count(*) AS n, count(*) FILTER (source = 'api_schema') AS api, string_agg(name, ',' ORDER BY name) AS names FROM a GROUP BY url),
t AS (SELECT *, concat('https://h', c_custkey, '.example/') AS url FROM customer)
SELECT concat('h', c_custkey, '.example') AS domain, url, CASE WHEN c_custkey % 4 = 0 THEN 'html_extraction' WHEN coalesce(n, 0) > coalesce(api, 0) THEN 'hybrid' ELSE 'api' END AS source,
  CASE WHEN c_custkey % 4 = 2 THEN 'complete' ELSE 'partial' END AS coverage, coalesce(names, '') AS names FROM t LEFT JOIN g USING (url)""",
    "registry_listed": """
SELECT p_name AS site, 'c1' AS intent_category, CASE WHEN 1 + p_size % 32 > 12 THEN substring(h, 1, 12) || '…' ELSE substring(h, 1, 1 + p_size % 32) END AS version
FROM (SELECT *, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part) WHERE p_partkey % 3 = 1 AND contains(lower(p_name), 'e')""",
    "dashboard_urls": """
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'https://' || h WHEN 3 THEN 'https://api.' || h WHEN 1 THEN 'https://' || rtrim(h, '/') ELSE 'http://api.' || rtrim(h, '/') END || '/dashboard' AS dashboard
FROM (SELECT n_nationkey, lower(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN '.example//' ELSE '.example' END AS h FROM nation)""",
    "page_patterns": """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END AS next_page, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS "user",
  nullif(CAST(page_id % 3 = 0 AS INTEGER) + CAST(page_id % 2 = 0 AS INTEGER), 0) AS n FROM pages""",
    "probe_outputs": """
SELECT 'u' || c_custkey AS url, '{"url":"u' || c_custkey || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"strategy":"json_suffix"' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ',"stealth_required":true' ELSE '' END
  || CASE WHEN c_custkey % 5 > 0 THEN ',"has_html":true,"html_size_bytes":' || strlen(c_name) ELSE '' END
  || CASE c_custkey % 3 WHEN 0 THEN '' ELSE ',"candidates":[' || CASE WHEN c_custkey % 3 = 2 THEN '{"strategy":"s2","score":20},' ELSE '' END || '{"strategy":"s1","score":10,"schema_id":"id","endpoint_count":1}]' END || '}' AS json
FROM customer""",
    "schema_round_trip": """
SELECT c_custkey, CASE WHEN k THEN c_name END AS id, CASE WHEN k THEN CAST(c_custkey % 5 AS INTEGER) END AS version, CASE WHEN k THEN c_mktsegment END AS name, CASE WHEN k THEN c_name END AS phone,
  CASE WHEN k THEN c_custkey / 8.0::DOUBLE END AS confidence FROM (SELECT *, c_custkey % 7 > 0 AS k FROM customer)""",
    "previews": f"""
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN '{{' || {_NL} || '  "a": ' || event_id || ',' || {_NL} || '  "t": "' || repeat('x', least(event_id % 130, 80)) || CASE WHEN event_id % 130 > 80 THEN '...' ELSE '' END || '"' || {_NL} || '}}'
  ELSE repeat('y', least(event_id % 30 * 100, 2000)) || CASE WHEN event_id % 30 > 20 THEN '...' ELSE '' END END AS preview FROM events""",
    "dom_snapshots": f"""
SELECT page_id, '<body>a <p>x' || page_id || '</p>' || CASE WHEN page_id % 8 < 6 THEN {_NL} || repeat('<div>', page_id % 8) || 'deep' || repeat('</div>', page_id % 8) ELSE '' END || '</body>' || {_NL} AS snapshot FROM pages""",
    "pattern_catalogue": "SELECT name, description, (SELECT count(*) FROM pages WHERE contains(html, name)) AS n_pages FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in assembly.PATTERN_DESCRIPTIONS) + ") t(name, description)",
}
