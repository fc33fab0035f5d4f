"""Captured traffic: filters, totals, joins, walls, markers and script hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import catalog, responses, traffic
from ..sources.tables import read_table
from . import views

_HAR = views.har_sql()


def _any(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


def har_filter(spark, d):
    return traffic.filter_har(views.har(spark, d)).select("capture_id", "ord", "method", "url", "content_type")


def har_summary(spark, d):
    return traffic.summarize_har(views.har(spark, d))


def har_request_response(spark, d):
    rows = views.har(spark, d)
    requests = rows.select(F.col("ord").alias("request_id"), "method", "url")
    responses = rows.filter("ord % 3 <> 0").select(F.col("ord").alias("request_id"), "status", "content_type")
    return traffic.join_responses(requests, responses)


def har_best_response(spark, d):
    return traffic.best_response(views.har(spark, d), F.lit("/api/orders/3")).select("capture_id", "ord", "url", "score")


def har_included_merge(spark, d):
    body = F.concat(
        F.lit('{"included":[{"entityUrn":"u'), (F.col("ord") % 7).cast("string"), F.lit('","v":'), F.col("ord").cast("string"),
        F.lit('},{"v":'), F.col("ord").cast("string"), F.lit("}]}"),
    )
    rows = views.har(spark, d).withColumn("body", body)
    return traffic.merge_included(rows).select("capture_id", "ord", F.col("pos").cast("int").alias("pos"), "urn")


#: Bodies of captured entries: objects with and without lists, a list, none, and no JSON. Both engines run it.
_PAYLOADS = """CASE ord % 6
  WHEN 0 THEN concat('{"included":[{"entityUrn":"u', ord % 9, '","v":', ord, '},{"v":', ord, '},7,{"entityUrn":5,"v":', ord, '}],"data":', ord, ',"b c":null}')
  WHEN 1 THEN concat('{"data":[', ord, ']}') WHEN 2 THEN concat('[', ord, ']') WHEN 3 THEN concat('{"included":[{"entityUrn":"u', ord % 5, '","v":', ord, '}')
  WHEN 4 THEN '' ELSE concat('{"included":{"v":', ord, '}}') END"""


def complete_payloads(spark, d):
    """Each capture's best payload with all that was included: its members' names, and the values of its items in order."""
    found = responses.complete_payloads(views.har(spark, d).withColumn("body", F.expr(_PAYLOADS)), F.lit("/api/orders/3"))
    items = F.try_variant_get(F.try_parse_json("payload"), "$.included", "array<variant>")
    values = F.array_join(F.transform(items, lambda x: F.try_variant_get(x, "$.v", "string")), ",")
    return found.select("capture_id", "best_ord", "n_included", F.array_join(F.array_sort(F.map_keys(F.from_json("payload", "map<string,variant>"))), ",").alias("members"), values.alias("item_values"))


def responses_by_endpoint(spark, d):
    rows = views.har(spark, d).select("capture_id", "ord", F.col("event_type").alias("name"), "status", F.concat(F.lit('{"n":'), F.col("ord").cast("string"), F.lit("}")).alias("body"))
    return traffic.merge_by_endpoint(rows)


def replay_requests(spark, d):
    rows = views.har(spark, d).select(F.when(F.col("ord") % 9 != 0, F.col("url")).alias("url"), F.when(F.col("ord") % 2 == 0, F.col("method")).otherwise("").alias("method"), "body")
    return traffic.as_requests(rows)


def auth_wall(spark, d):
    rows = views.har(spark, d)
    return rows.select("ord", traffic.needs_auth(F.col("status"), F.col("url"), F.col("body")).alias("needs_auth"))


def block_detection(spark, d):
    return views.har(spark, d).select("ord", traffic.is_blocked(F.col("status"), F.col("body")).alias("blocked"), traffic.failure_kind(F.col("status")).alias("kind"))


def marker_hits(spark, d):
    body = F.concat("html", F.when(F.col("page_id") % 3 == 0, "<!-- DataDome cf_chl_opt -->").otherwise(""))
    cookies = F.when(F.col("page_id") % 4 == 0, "_abck=1; x=2").otherwise("")
    hits = read_table(spark, d, "pages").select("page_id", traffic.marker_hits(body, cookies).alias("hits"))
    return hits.select("page_id", F.array_join(F.transform("hits", lambda h: F.concat_ws("/", h["name"], h["location"], h["marker"])), ",").alias("hits"))


def _with_scripts():
    k = (F.col("page_id") % 5).cast("string")
    return F.concat(
        F.lit('<script src="https://cdn'), k, F.lit(".Example.net/a.js\"></script><script src='//static.example.org:8080/b.js'></script><img src=\"/local.png\">"),
        F.lit('<link rel="preconnect" href="https://fonts'), k, F.lit('.example.com/"><link href="//dns.example.com" rel=dns-prefetch><meta name="generator" content="Gen '), k, F.lit('">'),
        F.col("html"),
    )


def script_hosts(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.array_join(traffic.script_hosts(_with_scripts()), ",").alias("hosts"))


def preconnect_hosts(spark, d):
    return read_table(spark, d, "pages").select("page_id", F.array_join(traffic.preconnect_hosts(_with_scripts()), ",").alias("hosts"))


def meta_generator(spark, d):
    return read_table(spark, d, "pages").select("page_id", traffic.meta_generator(_with_scripts()).alias("generator"))


def strip_script_style(spark, d):
    html = tx.strip_script_style(F.col("html"))
    return read_table(spark, d, "pages").select("page_id", F.sha2(html, 256).alias("html_sha256"), F.octet_length(html).alias("n_bytes"))


def thin_page(spark, d):
    return read_table(spark, d, "pages").select("page_id", tx.is_thin(F.col("html"), 1000).alias("thin"))


def header_filter(spark, d):
    headers = F.create_map(*map(F.lit, ["User-Agent", "x"]), F.lit("X-Type"), F.col("event_type"), F.lit("Accept"), F.lit("*/*"), F.lit("DNT"), F.lit("1"))
    kept = traffic.relevant_headers(headers)
    return read_table(spark, d, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), F.try_element_at(kept, k))), ";").alias("headers"))


def domain_semi_join(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", "url")
    domains = pages.filter("page_id % 7 = 0").select(urls.bare_host(F.col("url")).alias("domain")).distinct()
    return traffic.host_is_spa(pages, domains).select("page_id", "domain")


def domain_anti_join(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", urls.bare_host(F.col("url")).alias("domain"))
    return pages.join(pages.filter("page_id % 7 = 0").select("domain").distinct(), "domain", "left_anti")


def url_domain_suffix_match(spark, d):
    hosts = read_table(spark, d, "pages").select(urls.hostname(F.col("url")).alias("host")).distinct()
    jars = spark.createDataFrame([("example.com", 1), ("example.net", 2), ("m.example.com", 3), ("www.ththre.example.com", 4)], "domain string, jar int")
    return catalog.suffix_lookup(hosts, jars).select("host", "domain", "jar")


def wellknown_cross(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", urls.authority(F.col("url")).alias("host"))
    captured = pages.filter("page_id % 3 = 0").groupBy("host").agg(F.min("page_id").alias("p")).select("host", F.lit("/robots.txt").alias("path"), F.when(F.col("p") % 2 == 0, 200).otherwise(404).alias("status"))
    return catalog.well_known(pages.select("host").distinct(), captured)


QUERIES = {f.__name__: f for f in (
    har_filter, har_summary, har_request_response, har_best_response, har_included_merge, responses_by_endpoint, replay_requests, auth_wall,
    block_detection, marker_hits, script_hosts, preconnect_hosts, meta_generator, strip_script_style, thin_page, header_filter, domain_semi_join,
    domain_anti_join, url_domain_suffix_match, wellknown_cross, complete_payloads,
)}

_API = "(contains(lower(content_type), 'json') OR contains(lower(content_type), 'graphql'))"
_SCRIPTS = """('<script src="https://cdn' || page_id % 5 || '.Example.net/a.js"></script><script src=''//static.example.org:8080/b.js''></script><img src="/local.png">'
  || '<link rel="preconnect" href="https://fonts' || page_id % 5 || '.example.com/"><link href="//dns.example.com" rel=dns-prefetch><meta name="generator" content="Gen ' || page_id % 5 || '">' || html)"""
_BARE = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\.|:[0-9]*$', '', 'g')"
_AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"
_MARKERS = "(VALUES " + ", ".join(f"('{n}', '{p}', '{m}')" for n, p, m in traffic.MARKERS) + ") AS m(name, place, marker)"
_NOSCRIPT = r"regexp_replace(regexp_replace(html, '<(?:script)\b.*?</script[^>]*>', '', 'gis'), '<(?:style)\b.*?</style[^>]*>', '', 'gis')"
_PATHS = "(VALUES " + ", ".join(f"({k}, '{p}', '{kind}')" for k, (p, kind) in enumerate(catalog.WELL_KNOWN)) + ") AS w(idx, path, kind)"

ORACLE_SQL = {
    "complete_payloads": f"""
WITH e AS MATERIALIZED (SELECT * FROM (SELECT capture_id, ord, url, status, {_PAYLOADS} AS body FROM ({_HAR})) WHERE status = 200 AND body <> '' AND json_valid(body)),
i AS (
  SELECT capture_id, ord, unnest(json_extract(body, '$.included[*]')) AS item, unnest(generate_series(1, len(json_extract(body, '$.included[*]')))) AS pos
  FROM e WHERE json_type(body, '$.included') = 'ARRAY'
), o AS (
  SELECT *, CASE WHEN json_type(item, '$.entityUrn') = 'VARCHAR' THEN item->>'$.entityUrn' END AS urn FROM i WHERE json_type(item) = 'OBJECT'
), k AS (SELECT * FROM o QUALIFY urn IS NULL OR row_number() OVER (PARTITION BY capture_id, urn ORDER BY ord, pos) = 1),
g AS (SELECT capture_id, count(*) AS n, string_agg(item->>'$.v', ',' ORDER BY ord, pos) AS item_values FROM k GROUP BY capture_id),
s AS (
  SELECT *, strlen(body) + 50000 * (contains(lower(url), 'api')::INT + contains(lower(url), 'orders')::INT)
    + CASE WHEN contains(lower(url), 'graphql') OR contains(lower(url), '/api/') THEN 10000 ELSE 0 END
    - CASE WHEN contains(lower(url), 'setting') OR contains(lower(url), 'messaging') OR contains(lower(url), 'notification') OR contains(lower(url), 'policy') THEN 30000 ELSE 0 END AS score FROM e
), b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, ord) = 1)
SELECT coalesce(b.capture_id, g.capture_id) AS capture_id, b.ord AS best_ord, coalesce(n, 0) AS n_included,
  CASE WHEN json_type(b.body) = 'OBJECT' THEN array_to_string(list_sort(list_distinct(list_concat(json_keys(b.body), CASE WHEN n > 0 THEN ['included'] ELSE [] END))), ',')
    WHEN n > 0 THEN 'included' END AS members, item_values
FROM b FULL JOIN g ON b.capture_id = g.capture_id""",
    "har_filter": f"""
SELECT capture_id, ord, method, url, content_type FROM ({_HAR}) WHERE {_API} AND NOT {_any("lower(url)", traffic.TRACKING)}
QUALIFY row_number() OVER (PARTITION BY capture_id, method, url ORDER BY ord) = 1""",
    "har_summary": f"""
SELECT capture_id, count(*) AS n_requests, count(*) FILTER (WHERE {_API}) AS n_api, CAST(sum(strlen(coalesce(body, ''))) AS BIGINT) AS body_bytes
FROM ({_HAR}) GROUP BY capture_id""",
    "har_request_response": f"""
WITH h AS ({_HAR})
SELECT a.ord AS request_id, a.method, a.url, b.status, b.content_type FROM h a LEFT JOIN (SELECT * FROM h WHERE ord % 3 <> 0) b ON a.ord = b.ord""",
    "har_best_response": f"""
SELECT capture_id, ord, url, score FROM (
  SELECT capture_id, ord, url, CAST(strlen(coalesce(body, '')) + 50000 * (CAST(contains(lower(url), 'api') AS INT) + CAST(contains(lower(url), 'orders') AS INT))
    + CASE WHEN contains(lower(url), 'graphql') OR contains(lower(url), '/api/') THEN 10000 ELSE 0 END
    - CASE WHEN {_any("lower(url)", ["setting", "messaging", "notification", "policy"])} THEN 30000 ELSE 0 END AS BIGINT) AS score FROM ({_HAR}))
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, ord) = 1""",
    "har_included_merge": f"""
WITH h AS (SELECT capture_id, ord FROM ({_HAR}) WHERE capture_id % 10 = 0)
SELECT capture_id, min(ord) AS ord, 0 AS pos, 'u' || ord % 7 AS urn FROM h GROUP BY capture_id, ord % 7
UNION ALL SELECT capture_id, ord, 1 AS pos, NULL AS urn FROM h""",
    "responses_by_endpoint": f"""
SELECT capture_id, CASE WHEN bool_and(ok) THEN '{{' || string_agg('"' || name || '":' || body, ',' ORDER BY name) || '}}' END AS data FROM (
  SELECT capture_id, event_type AS name, arg_max('{{"n":' || ord || '}}', ord) AS body, bool_and(status BETWEEN 200 AND 299) AS ok
  FROM ({_HAR}) WHERE ord % 2 = 0 GROUP BY 1, 2) GROUP BY capture_id""",
    "replay_requests": f"SELECT url, CASE WHEN ord % 2 = 0 THEN method ELSE 'GET' END AS method, body FROM ({_HAR}) WHERE ord % 9 <> 0",
    "auth_wall": f"""
SELECT ord, status IN (401, 403) OR {_any("lower(url)", traffic.LOGIN_URLS)} OR {_any("lower(body)", traffic.LOGIN_TEXTS)} AS needs_auth FROM ({_HAR})""",
    "block_detection": f"""
SELECT ord, CASE WHEN status IN (403, 429, 503) THEN {_any("lower(body)", traffic.BLOCK_PHRASES)} WHEN status = 200 THEN {_any("lower(body)", traffic.SURE_PHRASES)} ELSE false END AS blocked,
  CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (429, 502, 503, 504) THEN 'transient' ELSE 'broken' END AS kind FROM ({_HAR})""",
    "marker_hits": f"""
WITH p AS (
  SELECT page_id, lower(html || CASE WHEN page_id % 3 = 0 THEN '<!-- DataDome cf_chl_opt -->' ELSE '' END) AS body, CASE WHEN page_id % 4 = 0 THEN '_abck=1; x=2' ELSE '' END AS cookies FROM pages
)
SELECT page_id, coalesce(string_agg(name || '/' || place || '/' || marker, ',' ORDER BY name, place, marker) FILTER (WHERE contains(CASE place WHEN 'body' THEN body ELSE cookies END, marker)), '') AS hits
FROM p CROSS JOIN {_MARKERS} GROUP BY page_id""",
    "script_hosts": rf"""
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({_SCRIPTS}, 'src=["''](?:https?:)?//([^/"''?#:]+)', 1, 'i'), lambda x: lower(x)))), ',') AS hosts FROM pages""",
    "preconnect_hosts": "SELECT page_id, 'dns.example.com,fonts' || page_id % 5 || '.example.com' AS hosts FROM pages",
    "meta_generator": "SELECT page_id, 'Gen ' || page_id % 5 AS generator FROM pages",
    "strip_script_style": f"SELECT page_id, sha256(h) AS html_sha256, CAST(strlen(h) AS INTEGER) AS n_bytes FROM (SELECT page_id, {_NOSCRIPT} AS h FROM pages)",
    "thin_page": rf"""
SELECT page_id, strlen(trim(regexp_replace(regexp_replace({_NOSCRIPT}, '<[^>]*>', ' ', 'g'), '[\s\p{{Z}}\x0B\x85]+', ' ', 'g'))) < 1000 AS thin FROM pages""",
    "header_filter": "SELECT event_id, 'Accept=*/*;X-Type=' || event_type AS headers FROM events",
    "domain_semi_join": f"""
SELECT page_id, domain FROM (SELECT page_id, {_BARE} AS domain FROM pages) p WHERE domain IN (SELECT {_BARE} FROM pages WHERE page_id % 7 = 0)""",
    "domain_anti_join": f"""
SELECT page_id, domain FROM (SELECT page_id, {_BARE} AS domain FROM pages) p WHERE domain NOT IN (SELECT {_BARE} FROM pages WHERE page_id % 7 = 0)""",
    "url_domain_suffix_match": rf"""
SELECT host, domain, jar FROM (SELECT DISTINCT lower(regexp_replace({_AUTH}, ':[0-9]*$', '')) AS host FROM pages) h
JOIN (VALUES ('example.com', 1), ('example.net', 2), ('m.example.com', 3), ('www.ththre.example.com', 4)) AS j(domain, jar) ON host = domain OR ends_with(host, '.' || domain)
QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(domain) DESC) = 1""",
    "wellknown_cross": f"""
WITH p AS (SELECT page_id, {_AUTH} AS host FROM pages), r AS (SELECT host, CASE WHEN min(page_id) % 2 = 0 THEN 200 ELSE 404 END AS status FROM p WHERE page_id % 3 = 0 GROUP BY host)
SELECT h.host, w.path, CAST(idx AS INTEGER) AS idx, kind, CAST(CASE WHEN w.path = '/robots.txt' THEN r.status END AS INTEGER) AS status
FROM (SELECT DISTINCT host FROM p) h CROSS JOIN {_PATHS} LEFT JOIN r ON h.host = r.host""",
}
