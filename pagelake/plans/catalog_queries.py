"""Schemas, endpoints, probes and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates
from ..functions import semantics
from ..functions import text as tx
from ..functions import urls
from ..operators import catalog
from ..sources.tables import read_table
from . import views
from .url_queries import _AUTH, _PATH, _segs, norm_sql

#: A fixed point in time for expiry.
NOW = "2024-02-01 00:00:00"
TTL = 30 * 86400


def _urls(spark, d):
    return read_table(spark, d, "pages").select("page_id", "url")


def _patterns(spark, d):
    """Distinct normalised patterns of all pages, and /{}/{} for every host."""
    rows = _urls(spark, d).select("page_id", urls.authority(F.col("url")).alias("domain"), urls.normalize_path(urls.path(F.col("url"))).alias("p"))
    both = rows.select("domain", F.col("p").alias("url_pattern")).unionByName(rows.select("domain", F.lit("/{}/{}").alias("url_pattern")))
    return both.distinct().withColumn("ord", F.xxhash64("domain", "url_pattern"))


def _schemas(spark, d):
    base = _patterns(spark, d).withColumn("n", F.length("domain") + F.length("url_pattern"))
    kind = F.when(F.col("n") % 2 == 0, "api").otherwise("css")
    created = F.to_timestamp(F.lit(NOW)) - F.make_dt_interval(F.col("n") % 50)
    return base.select("domain", "url_pattern", "ord", kind.alias("schema_type"), created.alias("created_at"))


def pattern_match_best(spark, d):
    return catalog.match_patterns(_urls(spark, d), _patterns(spark, d)).select("page_id", "domain", "url_pattern", "specificity")


def schema_lookup_priority(spark, d):
    return catalog.lookup(_urls(spark, d), _schemas(spark, d), F.to_timestamp(F.lit(NOW)), TTL).select("url", "url_pattern", "bucket")


def schema_ttl_expired(spark, d):
    return _schemas(spark, d).filter(F.unix_timestamp(F.to_timestamp(F.lit(NOW))) - F.unix_timestamp("created_at") > TTL).select("domain", "url_pattern")


def schema_store_if_no_api(spark, d):
    live = catalog.lookup(_urls(spark, d), _schemas(spark, d), F.to_timestamp(F.lit(NOW)), TTL).filter("bucket = 'api'")
    return _urls(spark, d).join(live.select("url"), "url", "left_anti").select("page_id")


def schema_upsert_latest(spark, d):
    rows = read_table(spark, d, "orders").select(
        F.concat(F.lit("d"), F.col("o_custkey") % 50).alias("domain"), (F.col("o_orderkey") % 9).cast("string").alias("id"),
        (F.col("o_orderkey") % 1000).cast("int").alias("version"), F.col("o_orderkey").alias("payload"),
    )
    newest = rows.groupBy("domain", "id", "version").agg(F.max("payload").alias("payload"))
    return catalog.upsert(newest.filter("payload % 2 = 0"), newest.filter("payload % 2 = 1"))


def schemas_per_domain(spark, d):
    return _schemas(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n_schemas"), catalog.merged_coverage(F.when(F.col("schema_type") == "api", "complete").otherwise("partial")).alias("coverage"))


def schema_merge_endpoints(spark, d):
    """Without the numbers in their templates, many endpoints of one side are one."""
    side = lambda k: views.endpoints(spark, d, k).withColumn("url_template", F.regexp_replace("url_template", "/[0-9]+", ""))
    return catalog.merge_endpoints(side(0), side(1)).drop("ord")


def known_sites(spark):
    rows = [(1, "net", r"\.example\.net$", r"^/(en|de)/", "https://{host}/api/{id}"), (2, "com", r"example\.com$", r"^/[a-z]{2}/[0-9]+$", "https://api.example.com/{id}.json"), (3, "any", ".", r"\.html$", "https://html/{id}")]
    return spark.createDataFrame(rows, "ord int, site string, host_pattern string, path_pattern string, api_template string")


def known_site_match(spark, d):
    return catalog.known_site(_urls(spark, d), known_sites(spark)).select("page_id", "site")


def known_site_api_url(spark, d):
    found = catalog.known_site(_urls(spark, d), known_sites(spark))
    last = F.regexp_replace(F.element_at(urls.segments(urls.path(F.col("url"))), -1), r"\.html$", "")
    filled = F.replace(F.replace("api_template", F.lit("{id}"), last), F.lit("{host}"), urls.hostname(F.col("url")))
    return found.select("page_id", filled.alias("api_url"))


def probe_candidates_ranked(spark, d):
    asked = catalog.probe_candidates(_urls(spark, d))
    pattern = urls.normalize_path(urls.path(F.col("url")))
    scored = asked.withColumn("score", catalog.probe_score(F.col("strategy"), pattern, F.col("strategy") == "accept_header")).withColumn("method", F.lit("GET")).withColumn("url_template", F.col("probe_url"))
    return catalog.rank_candidates(scored).select("page_id", "strategy", "score", F.col("rank").cast("int").alias("rank"))


def endpoint_rank(spark, d):
    rows = views.endpoints(spark, d).select("domain", "url_template", F.col("confidence").alias("semantic_score"), (F.col("ord") % 17).alias("response_size"), "ord")
    return catalog.rank_endpoints(rows, ["domain"]).select("domain", "url_template", "ord", F.col("rank").cast("int").alias("rank"), "is_primary")


def url_semantic_score(spark, d):
    rows = _urls(spark, d).select("page_id", "url", urls.path(F.col("url")).alias("target"))
    host = F.regexp_replace(F.lower(F.element_at(F.split("target", "/"), -1)), "[^a-z0-9]", "")
    probes = rows.select("page_id", "url", F.explode(F.array(
        F.concat(F.lit("https://x.example.com"), F.col("target")), F.concat(F.lit("https://x.example.com"), F.regexp_replace("target", "/$", ""), F.lit(".json")),
        F.concat(F.lit("https://x.example.com/api"), F.col("target")), F.concat(F.lit("https://x"), host, F.lit(".example.com/none")),
    )).alias("endpoint"))
    return probes.select("page_id", "endpoint", semantics.url_score(semantics.target_signals(F.col("url")), F.col("endpoint")).cast("double").alias("score"))


def confidence_merge(spark, d):
    value = read_table(spark, d, "part").select("p_partkey", ((F.col("p_size") - 10) / 50.0).alias("a"), ((F.col("p_partkey") % 30 - 5) / 30.0).alias("b"))
    return value.select("p_partkey", tx.merged_confidence(F.col("a"), F.col("b")).alias("confidence"))


def _actions(spark, d):
    size = F.col("p_size")
    params = F.transform(F.sequence(F.lit(1), size % 3 + 1), lambda k: F.struct(F.when(k == 1, "q").otherwise(F.concat(F.lit("url"), k.cast("string"))).alias("name"), (k % 2 == 1).alias("required")))
    return read_table(spark, d, "part").select(
        (F.col("p_partkey") % 40).alias("site"), F.concat(F.lit("a"), F.col("p_partkey") % 3).alias("name"),
        F.when(size % 2 == 0, "search").otherwise("navigate").alias("kind"), F.when(size % 3 == 0, "api_call").otherwise("http_get").alias("transport"),
        F.when(size % 4 == 0, "api_schema").otherwise("url_pattern").alias("source"), ((size % 20) / F.lit(20.0)).alias("confidence"),
        F.concat(F.lit("https://x/"), (F.col("p_partkey") % 6).cast("string"), F.when(size % 5 == 0, "?q={q}&ref=1").otherwise("")).alias("url_template"), params.alias("params"), "p_partkey",
    )


def action_rank(spark, d):
    a = _actions(spark, d)
    return a.select("p_partkey", catalog.action_rank(a).cast("int").alias("rank"))


def action_dedupe(spark, d):
    return catalog.dedupe_actions(_actions(spark, d).drop("p_partkey"), ["site"]).select("site", "name", "transport", "url_template", F.col("rank").cast("int").alias("rank"))


def catalog_union(spark, d):
    targets = _urls(spark, d).withColumn("domain", urls.authority(F.col("url"))).select("domain", "url")
    by_url = catalog.url_actions(targets).drop("url")
    by_schema = catalog.schema_actions(views.endpoints(spark, d).withColumn("domain", F.lit("api.example.com")))
    both = by_url.unionByName(by_schema)
    return both.groupBy("domain", "kind", "source").agg(F.count(F.lit(1)).alias("n"))


def template_fill_strict(spark, d):
    variables = [("lang", "path", "0"), ("id", "path", "^([0-9]+)$"), ("page", "query", "page"), ("v", "fixed", "1")]
    filled = templates.fill_strict(F.lit("https://api.example.com/{v}/{lang}/{id}?p={page}"), F.col("url"), variables)
    return _urls(spark, d).select("page_id", filled.alias("filled"))


def template_fill_lenient(spark, d):
    variables = [("lang", "path", "0"), ("id", "path", "^([0-9]+)$"), ("rest", "path_rest", "1")]
    filled = templates.fill_lenient(F.lit("https://api.example.com/{lang}/{id}/{rest}/{other}"), F.col("url"), variables)
    return _urls(spark, d).select("page_id", filled.alias("filled"))


QUERIES = {f.__name__: f for f in (
    pattern_match_best, schema_lookup_priority, schema_ttl_expired, schema_store_if_no_api, schema_upsert_latest, schemas_per_domain,
    schema_merge_endpoints, known_site_match, known_site_api_url, probe_candidates_ranked, endpoint_rank, url_semantic_score, confidence_merge,
    action_rank, action_dedupe, catalog_union, template_fill_strict, template_fill_lenient,
)}

_PATTERNS = f"""
SELECT DISTINCT domain, url_pattern FROM (
  SELECT {_AUTH} AS domain, {norm_sql(_PATH)} AS url_pattern FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT {_AUTH}, '/{{}}/{{}}' FROM pages)"""
_SPEC = f"coalesce(list_sum(list_transform({_segs('url_pattern')}, lambda s: CASE WHEN s = '{{}}' THEN 1 ELSE 10 END)), 0)"
_MATCHED = f"""
SELECT page_id, url, u.domain, p.*, {_SPEC} AS specificity FROM (SELECT page_id, url, {_AUTH} AS domain, {_segs(norm_sql(_PATH))} AS us FROM pages) u
JOIN (SELECT * EXCLUDE (domain), domain AS pd, {_segs("url_pattern")} AS ps FROM SOURCE) p ON u.domain = p.pd AND len(us) = len(ps)
  AND len(list_filter(list_zip(ps, us), lambda z: z[1] <> '{{}}' AND z[1] <> z[2])) = 0"""
_SCHEMAS = f"""
SELECT domain, url_pattern, CASE WHEN n % 2 = 0 THEN 'api' ELSE 'css' END AS schema_type, n % 50 <= 30 AS live FROM (
  SELECT *, length(domain) + length(url_pattern) AS n FROM ({_PATTERNS}))"""
_LOOKUP = f"""
SELECT url, url_pattern, bucket FROM (
  SELECT url, url_pattern, schema_type AS bucket FROM ({_MATCHED.replace("SOURCE", f"({_SCHEMAS}) WHERE live")})
  QUALIFY row_number() OVER (PARTITION BY url, schema_type ORDER BY specificity DESC) = 1
) QUALIFY row_number() OVER (PARTITION BY url ORDER BY bucket) = 1"""
_RANK = """CAST(floor(confidence * 100) AS INTEGER) + CASE transport WHEN 'api_call' THEN 40 ELSE 15 END + CASE kind WHEN 'search' THEN 30 ELSE 5 END
  + CASE source WHEN 'api_schema' THEN 20 ELSE 15 END - 4 * np + 18 - CASE WHEN np >= 2 THEN 2 ELSE 0 END
  - CASE WHEN contains(url_template, 'ref=') THEN 12 ELSE 0 END + CASE WHEN contains(url_template, '{q}') THEN 20 ELSE 0 END + CASE WHEN kind = 'search' AND np = 1 THEN 10 ELSE 0 END"""
_ACTIONS = """
SELECT p_partkey, p_partkey % 40 AS site, 'a' || p_partkey % 3 AS name, CASE WHEN p_size % 2 = 0 THEN 'search' ELSE 'navigate' END AS kind,
  CASE WHEN p_size % 3 = 0 THEN 'api_call' ELSE 'http_get' END AS transport, CASE WHEN p_size % 4 = 0 THEN 'api_schema' ELSE 'url_pattern' END AS source,
  (p_size % 20) / 20.0 AS confidence, 'https://x/' || p_partkey % 6 || CASE WHEN p_size % 5 = 0 THEN '?q={q}&ref=1' ELSE '' END AS url_template, p_size % 3 + 1 AS np FROM part"""
_LAST = rf"regexp_replace(list_last({_segs(_PATH)}), '\.html$', '')"
_SITES = rf"""
SELECT page_id, url, CASE WHEN regexp_matches(h, '\.example\.net$') AND regexp_matches(p, '^/(en|de)/') THEN 'net'
  WHEN regexp_matches(h, 'example\.com$') AND regexp_matches(p, '^/[a-z]{{2}}/[0-9]+$') THEN 'com' WHEN regexp_matches(p, '\.html$') THEN 'any' END AS site, h, {_LAST} AS last
FROM (SELECT page_id, url, lower(regexp_replace({_AUTH}, ':[0-9]*$', '')) AS h, {_PATH} AS p FROM pages)"""
_URL0 = r"regexp_replace(url, '[?#].*$', '')"

ORACLE_SQL = {
    "pattern_match_best": f"""
SELECT page_id, domain, url_pattern, CAST(specificity AS INTEGER) AS specificity FROM ({_MATCHED.replace("SOURCE", f"({_PATTERNS})")})
QUALIFY row_number() OVER (PARTITION BY url ORDER BY specificity DESC) = 1""",
    "schema_lookup_priority": _LOOKUP,
    "schema_ttl_expired": f"SELECT domain, url_pattern FROM ({_SCHEMAS}) WHERE NOT live",
    "schema_store_if_no_api": f"SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM ({_LOOKUP}) WHERE bucket = 'api')",
    "schema_upsert_latest": """
WITH r AS (SELECT 'd' || o_custkey % 50 AS domain, CAST(o_orderkey % 9 AS VARCHAR) AS id, CAST(o_orderkey % 1000 AS INTEGER) AS version, max(o_orderkey) AS payload FROM orders GROUP BY 1, 2, 3)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY domain, id ORDER BY version DESC, payload % 2 DESC) = 1""",
    "schemas_per_domain": f"""
SELECT domain, count(*) AS n_schemas, CASE WHEN bool_or(schema_type = 'api') THEN 'complete' ELSE 'partial' END AS coverage FROM ({_SCHEMAS}) GROUP BY domain""",
    "schema_merge_endpoints": f"""
WITH r AS (
  SELECT 0 AS side, * REPLACE (regexp_replace(url_template, '/[0-9]+', '') AS url_template) FROM ({views.endpoints_sql(0)})
  UNION ALL SELECT 1, * REPLACE (regexp_replace(url_template, '/[0-9]+', '') AS url_template) FROM ({views.endpoints_sql(1)})
), g AS (
  SELECT domain, url_template, upper(method) AS k, min(side * 1000000000 + ord) AS pos,
    list({{'name': name, 'description': description, 'method': method, 'confidence': confidence}} ORDER BY side, ord) AS l FROM r GROUP BY 1, 2, 3
), m AS (
  SELECT domain, url_template, pos, list_reduce(l, lambda a, x: {{
    'name': CASE WHEN a.name IN ('', 'directJSON') THEN x.name ELSE a.name END,
    'description': CASE WHEN a.description = '' OR (a.description = CASE WHEN a.name IN ('', 'directJSON') THEN x.name ELSE a.name END AND x.description <> '') THEN x.description ELSE a.description END,
    'method': CASE WHEN x.method <> '' THEN x.method ELSE a.method END, 'confidence': greatest(a.confidence, x.confidence)}}) AS e FROM g
)
SELECT domain, e.method AS method, url_template, e.name AS name, e.description AS description, e.confidence AS confidence,
  row_number() OVER (PARTITION BY domain ORDER BY e.confidence DESC, pos) = 1 AS is_primary FROM m""",
    "known_site_match": f"SELECT page_id, site FROM ({_SITES}) WHERE site IS NOT NULL",
    "known_site_api_url": f"""
SELECT page_id, CASE site WHEN 'net' THEN 'https://' || h || '/api/' || last WHEN 'com' THEN 'https://api.example.com/' || last || '.json' ELSE 'https://html/' || last END AS api_url
FROM ({_SITES}) WHERE site IS NOT NULL""",
    "probe_candidates_ranked": f"""
WITH c AS (
  SELECT page_id, url, strategy, CASE strategy WHEN 'json_suffix' THEN rtrim({_URL0}, '/') || '.json' WHEN 'accept_header' THEN url
      ELSE regexp_extract(url, '^[A-Za-z]+://', 0) || {_AUTH} || '/wp-json/wp/v2/posts?slug=' || list_last({_segs(_PATH)}) END AS t,
    CASE strategy WHEN 'json_suffix' THEN 120 WHEN 'accept_header' THEN 75 ELSE 20 END + CASE WHEN contains({norm_sql(_PATH)}, '{{}}') THEN 10 ELSE 0 END AS score
  FROM pages, (VALUES ('json_suffix'), ('accept_header'), ('wp_json')) AS s(strategy) WHERE (page_id + length(strategy)) % 4 <> 0
), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url, t ORDER BY score DESC, strategy) = 1)
SELECT page_id, strategy, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY url ORDER BY score DESC, strategy) AS INTEGER) AS rank FROM f""",
    "endpoint_rank": f"""
SELECT domain, url_template, ord, CAST(r AS INTEGER) AS rank, r = 1 AS is_primary FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, ord % 17 DESC, ord) AS r FROM ({views.endpoints_sql(0)}) WHERE confidence >= 0.55)""",
    "url_semantic_score": rf"""
WITH t AS (SELECT page_id, {_PATH} AS target FROM pages), e AS (
  SELECT page_id, target, unnest(['https://x.example.com' || target, 'https://x.example.com' || regexp_replace(target, '/$', '') || '.json', 'https://x.example.com/api' || target,
    'https://x' || regexp_replace(lower(list_last(string_split(target, '/'))), '[^a-z0-9]', '', 'g') || '.example.com/none']) AS endpoint FROM t
), s AS (
  SELECT page_id, endpoint, trim(lower(target), '/') AS target, trim(lower(regexp_extract(endpoint, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/') AS own FROM e
), p AS (SELECT *, list_filter(list_transform(string_split(target, '/'), lambda s: regexp_replace(s, '\.json$', '')), lambda s: s <> '') AS parts FROM s)
SELECT page_id, endpoint, CAST(CASE WHEN own = target AND own <> '' THEN 0.72 WHEN regexp_replace(own, '\.json$', '') = target AND own <> '' THEN 0.82
  WHEN len(parts) >= 2 AND contains(own, parts[-2] || '/' || parts[-1]) THEN 0.66 WHEN len(parts) >= 1 AND contains(own, parts[-1]) THEN 0.58 ELSE 0 END AS DOUBLE) AS score FROM p""",
    "confidence_merge": """
SELECT p_partkey, CAST(coalesce(greatest(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END), 0) AS DOUBLE) AS confidence
FROM (SELECT p_partkey, CAST(p_size - 10 AS DOUBLE) / 50.0 AS a, CAST(p_partkey % 30 - 5 AS DOUBLE) / 30.0 AS b FROM part)""",
    "action_rank": f"SELECT p_partkey, CAST({_RANK} AS INTEGER) AS rank FROM ({_ACTIONS})",
    "action_dedupe": f"""
WITH r AS (SELECT *, {_RANK} AS rank FROM ({_ACTIONS})),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site, name, transport, url_template ORDER BY rank DESC, name, np) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY site, name ORDER BY rank DESC, np, url_template) AS i FROM f)
SELECT site, CASE WHEN i > 1 THEN name || '_' || i ELSE name END AS name, transport, url_template, CAST(rank AS INTEGER) AS rank FROM n""",
    "catalog_union": f"""
SELECT domain, kind, source, count(*) AS n FROM (
  SELECT {_AUTH} AS domain, 'navigate' AS kind, 'url' AS source FROM pages
  UNION ALL SELECT 'api.example.com', CASE WHEN contains(url_template, '{{q}}') THEN 'search' ELSE 'fetch' END, 'api_schema' FROM ({views.endpoints_sql(0)})
) GROUP BY ALL""",
    "template_fill_strict": rf"""
SELECT page_id, CASE WHEN len(ids) > 0 THEN 'https://api.example.com/1/' || seg[1] || '/' || ids[-1] || '?p=' || page END AS filled FROM (
  SELECT page_id, {_segs(_PATH)} AS seg, list_filter({_segs(_PATH)}, lambda s: regexp_matches(s, '^[0-9]+$')) AS ids,
    regexp_extract(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(?:^|&)page=([^&]*)', 1) AS page FROM pages)""",
    "template_fill_lenient": f"""
SELECT page_id, 'https://api.example.com/' || seg[1] || '/' || CASE WHEN len(ids) > 0 THEN ids[-1] ELSE '{{id}}' END || '/' || array_to_string(seg[2:], '/') || '/{{other}}' AS filled FROM (
  SELECT page_id, {_segs(_PATH)} AS seg, list_filter({_segs(_PATH)}, lambda s: regexp_matches(s, '^[0-9]+$')) AS ids FROM pages)""",
}
