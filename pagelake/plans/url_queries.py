"""URL algebra over pages and texts, with the SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..sources.tables import read_table

_AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"
_RAW_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PATH = f"(CASE WHEN {_RAW_PATH} = '' THEN '/' ELSE {_RAW_PATH} END)"
_DYN = f"regexp_matches(s, '{urls.DYNAMIC}')"


def _segs(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda s: s <> '')"


def norm_sql(path: str) -> str:
    bare = rf"regexp_replace(regexp_replace({path}, '\?.*$', ''), '^/+|/+$', '', 'g')"
    return f"('/' || array_to_string(list_transform(string_split({bare}, '/'), lambda s: CASE WHEN {_DYN} THEN '{{}}' ELSE s END), '/'))"


def _pages(spark, d):
    return read_table(spark, d, "pages").select("page_id", "url")


def url_host_pattern_stats(spark, d):
    pages = read_table(spark, d, "pages")
    lang = F.regexp_extract("html", '<html lang="([a-z]*)"', 1)
    rows = pages.select(urls.authority(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), lang.alias("lang"))
    rows = rows.select("host", urls.normalize_path(F.col("path")).alias("pattern"), "lang", urls.schema_id(F.col("host"), F.col("path")).alias("id"))
    return rows.groupBy("host", "pattern", "lang", "id").agg(F.count(F.lit(1)).alias("n_pages"))


def url_schema_id(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.schema_id(urls.authority(u), urls.path(u)).alias("schema_id"))


def url_dynamic_segments(spark, d):
    seg = _pages(spark, d).select("page_id", F.posexplode(urls.segments(urls.path(F.col("url")))).alias("pos", "segment"))
    return seg.select("page_id", "pos", "segment", urls.is_dynamic(F.col("segment")).alias("is_dynamic"))


def url_nextdata_pattern(spark, d):
    return _pages(spark, d).select("page_id", urls.next_data_pattern(urls.path(F.col("url"))).alias("pattern"))


def url_normalize_host(spark, d):
    return _pages(spark, d).select("page_id", urls.bare_host(F.col("url")).alias("host"), urls.hostname(F.col("url")).alias("hostname"))


def url_templatize(spark, d):
    path = F.concat(F.lit("/r/"), F.regexp_replace(urls.path(F.col("url")), "^/", ""))
    slug = F.concat(F.lit("/users/"), F.regexp_extract(urls.authority(F.col("url")), "^([A-Za-z0-9-]+)", 1))
    return _pages(spark, d).select("page_id", urls.templatize(path).alias("by_id"), urls.templatize(slug).alias("by_slug"))


def url_specificity(spark, d):
    pattern = urls.normalize_path(urls.path(F.col("url")))
    return _pages(spark, d).select(pattern.alias("pattern")).distinct().select("pattern", urls.specificity(F.col("pattern")).alias("specificity"))


def url_query_parts(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.query(u).alias("query"), urls.query_value(u, "page").alias("page"), urls.query_value(u, "utm_source").alias("utm"))


def url_same_host(spark, d):
    u = F.col("url")
    other = F.concat(F.lit("HTTP://"), F.upper(urls.authority(u)), F.lit("/x"))
    return _pages(spark, d).select("page_id", urls.same_host(u, other).alias("same"), urls.same_host(u, F.lit("https://example.com/")).alias("example"))


def private_ips(spark, d):
    v4 = F.format_string("%d.%d.%d.%d", F.col("event_id") % 300, F.col("user_id") % 256, F.col("event_id") % 7, F.lit(1))
    v6 = F.concat(F.element_at(F.array(*map(F.lit, ["fe80", "fd12", "ff02", "2001"])), (F.col("user_id") % 4 + 1).cast("int")), F.lit("::"), F.col("user_id") % 10)
    case = F.col("event_id") % 8
    ip = F.when(case == 0, F.concat(F.lit("::ffff:"), v4)).when(case == 1, v6).when(case == 2, F.lit(None)).otherwise(v4)
    return read_table(spark, d, "events").select("event_id", ip.alias("ip"), urls.private_ip(ip).alias("is_private"))


def url_variable_names(spark, d):
    parts = urls.segments(urls.path(F.col("url")))
    seg = _pages(spark, d).select("page_id", parts.alias("parts")).select("page_id", "parts", F.posexplode("parts").alias("pos", "s"))
    parent = F.when(F.col("pos") > 0, F.get("parts", F.col("pos") - 1))
    return seg.select("page_id", "pos", urls.variable_name(parent, F.col("pos")).alias("name"))


def collapse_ws(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.collapse_whitespace(F.col("text")).alias("text"))


def clean_lines(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.clean_lines(F.col("text"), 1 << 30).alias("text"))


def cut_text(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.octet_length(tx.cut_bytes(F.col("text"), 200)).alias("n_bytes"), F.octet_length("text").alias("n_all"))


def clean_numbers(spark, d):
    value = F.round(F.col("value"), 1).cast("decimal(18,1)").cast("string")
    form = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("$"), value)).when(F.col("event_id") % 4 == 1, F.concat(value, F.lit("k")))
    form = form.when(F.col("event_id") % 4 == 2, F.concat((F.col("event_id") % 90).cast("string"), F.lit(" M"))).otherwise(F.concat(F.lit("1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))
    return read_table(spark, d, "events").select("event_id", tx.clean_number(form).alias("number"))


def action_name_norm(spark, d):
    return read_table(spark, d, "part").select("p_partkey", tx.action_name(F.concat(F.lit("  "), F.col("p_name"), F.lit("-#"), F.col("p_brand"))).alias("name"))


def backoff_delay(spark, d):
    return read_table(spark, d, "region").select("r_regionkey", tx.backoff_ms(F.col("r_regionkey") * 2).alias("wait_ms"))


def page_type_map(spark, d):
    return read_table(spark, d, "part").select(F.col("p_type")).distinct().select(
        "p_type", tx.schema_type(F.concat(F.when(F.col("p_type").contains("STEEL"), "NewsArticle").when(F.col("p_type").contains("BRASS"), "ItemList").otherwise("Product"), F.lit(""))).alias("kind")
    )


def ttl_and_sizes(spark, d):
    unit = F.element_at(F.array(*map(F.lit, "smhdx")), (F.col("event_id") % 5 + 1).cast("int"))
    text = F.concat((F.col("event_id") % 40).cast("string"), unit)
    return read_table(spark, d, "events").select("event_id", tx.ttl_seconds(text).alias("seconds"), tx.redact(F.concat(F.lit("token-"), F.col("event_id").cast("string"), F.repeat(F.lit("z"), (F.col("event_id") % 20).cast("int")))).alias("shown"))


QUERIES = {f.__name__: f for f in (
    url_host_pattern_stats, url_schema_id, url_dynamic_segments, url_nextdata_pattern, url_normalize_host, url_templatize, url_specificity,
    url_query_parts, url_same_host, private_ips, url_variable_names, collapse_ws, clean_lines, cut_text, clean_numbers, action_name_norm,
    backoff_delay, page_type_map, ttl_and_sizes,
)}

_PARENTS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in urls.RESOURCE_PARENTS.items()) + "}"
_NOISE = " OR ".join(f"contains(lower(x), '{p}')" for p in tx.NOISE_PHRASES)

ORACLE_SQL = {
    "url_host_pattern_stats": rf"""
SELECT host, pattern, lang, substr(sha256(host || ':' || pattern), 1, 16) AS id, count(*) AS n_pages FROM (
  SELECT {_AUTH} AS host, {norm_sql(_PATH)} AS pattern, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages
) GROUP BY ALL""",
    "url_schema_id": f"SELECT page_id, substr(sha256({_AUTH} || ':' || {norm_sql(_PATH)}), 1, 16) AS schema_id FROM pages",
    "url_dynamic_segments": f"""
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, s AS segment, {_DYN} AS is_dynamic FROM (
  SELECT page_id, unnest(seg) AS s, generate_subscripts(seg, 1) AS pos FROM (SELECT page_id, {_segs(_PATH)} AS seg FROM pages))""",
    "url_nextdata_pattern": f"""
SELECT page_id, CASE WHEN len(seg) > 1 THEN '/' || array_to_string(list_transform(seg, lambda s, i: CASE WHEN i = 1 THEN s ELSE '{{}}' END), '/')
  ELSE norm END AS pattern FROM (SELECT page_id, {_segs(_PATH)} AS seg, {norm_sql(_PATH)} AS norm FROM pages)""",
    "url_normalize_host": rf"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\.|:[0-9]*$', '', 'g') AS host,
  lower(regexp_replace({_AUTH}, ':[0-9]*$', '')) AS hostname FROM pages""",
    "url_templatize": f"""
WITH p AS (
  SELECT page_id, {_segs("'/r/' || regexp_replace(" + _PATH + ", '^/', '')")} AS seg, regexp_extract({_AUTH}, '^([A-Za-z0-9-]+)', 1) AS label FROM pages
)
SELECT page_id, '/' || array_to_string(list_transform(seg, lambda s, i: CASE WHEN {_DYN} THEN '{{param_' || (i - 1) || '}}'
    WHEN i = len(seg) AND len(seg) = 2 THEN '{{subreddit}}' ELSE s END), '/') AS by_id,
  '/users/' || CASE WHEN regexp_matches(label, '{urls.DYNAMIC}') THEN '{{param_1}}'
    WHEN label IN ({", ".join(f"'{x}'" for x in urls.RESERVED_SLUGS)}) THEN label ELSE '{{user}}' END AS by_slug FROM p""",
    "url_specificity": f"""
SELECT pattern, CAST(coalesce(list_sum(list_transform({_segs("pattern")}, lambda s: CASE WHEN s = '{{}}' THEN 1 ELSE 10 END)), 0) AS INTEGER) AS specificity
FROM (SELECT DISTINCT {norm_sql(_PATH)} AS pattern FROM pages)""",
    "url_query_parts": r"""
SELECT page_id, query, regexp_extract(query, '(?:^|&)page=([^&]*)', 1) AS page, regexp_extract(query, '(?:^|&)utm_source=([^&]*)', 1) AS utm
FROM (SELECT page_id, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages)""",
    "url_same_host": f"SELECT page_id, true AS same, lower({_AUTH}) = 'example.com' AS example FROM pages",
    "private_ips": """
SELECT event_id, CASE c WHEN 0 THEN '::ffff:' || v4 WHEN 1 THEN ['fe80', 'fd12', 'ff02', '2001'][user_id % 4 + 1] || '::' || (user_id % 10) WHEN 2 THEN NULL ELSE v4 END AS ip,
  CASE c WHEN 1 THEN user_id % 4 <> 3 WHEN 2 THEN true ELSE a > 255 OR a IN (10, 127) OR a BETWEEN 224 AND 239 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
    OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) END AS is_private
FROM (SELECT event_id, user_id, event_id % 8 AS c, event_id % 300 AS a, user_id % 256 AS b, (event_id % 300) || '.' || (user_id % 256) || '.' || (event_id % 7) || '.1' AS v4 FROM events)""",
    "url_variable_names": f"""
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos,
  coalesce({_PARENTS}[lower(parent)], CASE WHEN parent IS NULL OR parent = '{{}}' THEN 'param_' || (pos - 1) END,
    CASE WHEN lower(parent) LIKE '%ies' THEN regexp_replace(lower(parent), 'ies$', 'y') ELSE regexp_replace(lower(parent), 's$', '') END) AS name
FROM (SELECT page_id, pos, CASE WHEN pos > 1 THEN seg[pos - 1] END AS parent FROM (
  SELECT page_id, seg, unnest(generate_series(1, len(seg))) AS pos FROM (SELECT page_id, {_segs(_PATH)} AS seg FROM pages)))""",
    "collapse_ws": r"SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}\x0B\x85]+', ' ', 'g')) AS text FROM documents",
    "clean_lines": f"""
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)) AS text FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: octet_length(encode(x)) >= 3 AND NOT ({_NOISE})) AS l FROM documents)""",
    "cut_text": """
SELECT doc_id, CAST(CASE WHEN n <= 200 THEN n ELSE (SELECT max(b) FROM (SELECT strlen(left(text, i)) AS b FROM (SELECT unnest(range(1, 201)) AS i)) WHERE b <= 200) END AS INTEGER) AS n_bytes,
  CAST(n AS INTEGER) AS n_all FROM (SELECT doc_id, text, strlen(text) AS n FROM documents)""",
    "clean_numbers": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN CAST(CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)
  WHEN 2 THEN CAST((event_id % 90) * 1000000 AS VARCHAR) ELSE '1' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS number
FROM (SELECT event_id, CAST(round(value, 1) AS DECIMAL(18,1)) AS v FROM events)""",
    "action_name_norm": """
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('  ' || p_name || '-#' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part""",
    "backoff_delay": "SELECT r_regionkey, CAST(least(500 * pow(2.0, r_regionkey * 2), 5000.0) AS BIGINT) AS wait_ms FROM region",
    "page_type_map": """
SELECT p_type, CASE WHEN contains(p_type, 'STEEL') THEN 'article' WHEN contains(p_type, 'BRASS') THEN 'listing' ELSE 'product' END AS kind
FROM (SELECT DISTINCT p_type FROM part)""",
    "ttl_and_sizes": """
SELECT event_id, CAST((event_id % 40) * CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 END AS BIGINT) AS seconds,
  CASE WHEN length(t) <= 16 THEN '<redacted>' ELSE left(t, 8) || '…' || right(t, 4) END AS shown FROM (SELECT event_id, 'token-' || event_id || repeat('z', event_id % 20) AS t FROM events)""",
}
