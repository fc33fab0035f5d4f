"""Endpoint checks and joins: gate texts, pagination, valid bodies, results, parameters, schema merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import endpoints
from ..sources.tables import read_table
from . import views


def gate_texts(spark, d):
    shown = F.concat(F.element_at(F.array(*map(F.lit, ["HTTP ", "status ", "Status 4", "blocked by ", ""])), (F.col("ord") % 5 + 1).cast("int")), F.when(F.col("ord") % 3 == 0, "403").when(F.col("ord") % 3 == 1, "CloudFlare"))
    return views.har(spark, d).select("ord", shown.alias("message"), endpoints.is_gate_text(shown).alias("gate"))


_LINKS = ["https://x.example/list?page={n}", "/a/{n}", "/page-{n}/", "/pages/{n}", "?page=&q={n}", "https://page.example", "/a#page={n}"]
_TEXTS = [" Next ", "the NEXT PAGE please", "more", None]


def pagination_links(spark, d):
    href = F.replace(F.element_at(F.array(*map(F.lit, _LINKS)), (F.col("event_id") % 7 + 1).cast("int")), F.lit("{n}"), F.col("user_id").cast("string"))
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("event_id") % 4 + 1).cast("int"))
    return read_table(spark, d, "events").select("event_id", endpoints.is_pagination(text, href).alias("pages"))


def valid_bodies(spark, d):
    """A cap of 60 bytes, so that some bodies reach it."""
    body = F.when(F.col("ord") % 4 == 0, F.concat(F.lit(" \n"), F.col("body"))).when(F.col("ord") % 4 == 1, F.concat(F.lit('[{"a": "'), F.repeat(F.lit("x"), (F.col("ord") % 90).cast("int")))).otherwise(F.col("body"))
    return views.har(spark, d).select("ord", endpoints.valid_bytes(F.col("status"), body, 60).alias("n"))


def endpoint_results(spark, d):
    """Results of one URL each, several a template; templates of three numbers have none."""
    rows = views.har(spark, d).select("method", F.regexp_replace("url", "[0-9]+$", "{id}").alias("url_template"), "ord", F.octet_length("body").alias("response_size"), F.col("status").cast("double").alias("score"))
    asked = views.har(spark, d).select("method", F.when(F.col("ord") % 10 < 3, F.col("url")).otherwise(F.regexp_replace("url", "[0-9]+$", "{id}")).alias("url_template")).distinct()
    return endpoints.with_results(asked, rows).select("method", "url_template", "response_size", "score")


def param_values(spark, d):
    args = F.create_map(F.lit("q"), F.when(F.col("p_size") % 3 == 0, F.lit("  ")).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), F.col("p_name"))))
    return read_table(spark, d, "part").select("p_partkey", *[endpoints.param_value(args, F.lit(n), F.col("p_type")).alias(n) for n in ("q", "page")])


def parsed_params(spark, d):
    items = F.array(F.concat(F.lit(" a = "), F.col("p_name")), F.concat(F.lit("b=x="), F.col("p_partkey").cast("string")), F.when(F.col("p_size") % 2 == 0, F.lit("a=last")).otherwise("=none"), F.lit("flag"))
    found = endpoints.parse_params(items)
    return read_table(spark, d, "part").select("p_partkey", found["values"]["a"].alias("a"), found["values"]["b"].alias("b"), F.size(found["invalid"]).alias("n_invalid"))


_SIDE = """SELECT concat('d', c_custkey) AS domain, CASE WHEN c_custkey % 2 = 0 THEN 'css' ELSE 'api' END AS schema_type, CASE c_custkey % {m} WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' WHEN 2 THEN '' END AS coverage,
  CASE WHEN c_custkey % {s} = 0 THEN concat('s{k}-', c_custkey) END AS session, CASE WHEN c_custkey % 5 = {k} THEN '' ELSE concat('u{k}-', c_custkey) END AS discovered_from, concat('i{k}-', c_custkey) AS identity
FROM {{customer}} WHERE c_custkey % 7 <> {k}"""
_SIDES = [_SIDE.format(m=4, s=2, k=1), _SIDE.format(m=5, s=3, k=2)]


def schemas_merged(spark, d):
    """Two sets of schemas, each without a seventh of the domains."""
    sides = [spark.sql(s, customer=read_table(spark, d, "customer")) for s in _SIDES]
    return endpoints.merge_schemas(*sides)


QUERIES = {f.__name__: f for f in (gate_texts, pagination_links, valid_bodies, endpoint_results, param_values, parsed_params, schemas_merged)}

_HAR = views.har_sql()
_A, _B = (s.replace("{customer}", "customer") for s in _SIDES)
_TEMPLATE = "regexp_replace(url, '[0-9]+$', '{id}')"

ORACLE_SQL = {
    "gate_texts": f"""
SELECT ord, message, coalesce(regexp_matches(lower(message), 'http 403|403 forbidden|status 403|perimeterx|datadome|cloudflare|captcha|access denied|x-bogus|bot detect'), false) AS gate
FROM (SELECT ord, ['HTTP ', 'status ', 'Status 4', 'blocked by ', ''][ord % 5 + 1] || CASE ord % 3 WHEN 0 THEN '403' WHEN 1 THEN 'CloudFlare' END AS message FROM ({_HAR}))""",
    "pagination_links": "SELECT event_id, event_id % 4 < 2 OR event_id % 7 IN (0, 2) AS pages FROM events",
    "valid_bodies": f"""
SELECT ord, CAST(CASE WHEN status BETWEEN 200 AND 299 AND regexp_matches(b, '^\\s*[{{\\[]') AND (strlen(b) >= 60 OR json_valid(b)) THEN least(strlen(b), 60) ELSE 0 END AS INTEGER) AS n
FROM (SELECT ord, status, CASE ord % 4 WHEN 0 THEN ' ' || chr(10) || body WHEN 1 THEN '[{{"a": "' || repeat('x', ord % 90) ELSE body END AS b FROM ({_HAR}))""",
    "endpoint_results": f"""
WITH h AS ({_HAR}), a AS (SELECT DISTINCT method, CASE WHEN ord % 10 < 3 THEN url ELSE {_TEMPLATE} END AS url_template FROM h),
r AS (SELECT method, {_TEMPLATE} AS url_template, arg_min(strlen(body), ord) AS response_size, arg_min(status, ord) AS score FROM h GROUP BY ALL)
SELECT method, url_template, CAST(coalesce(response_size, 0) AS INTEGER) AS response_size, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM a LEFT JOIN r USING (method, url_template)""",
    "param_values": "SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN p_name ELSE p_type END AS q, p_type AS page FROM part",
    "parsed_params": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'last' ELSE p_name END AS a, 'x=' || p_partkey AS b, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_invalid FROM part""",
    "schemas_merged": f"""
SELECT domain, CASE WHEN a.domain IS NOT NULL AND b.domain IS NOT NULL THEN 'api' ELSE coalesce(a.schema_type, b.schema_type) END AS schema_type,
  CASE WHEN 'complete' IN (coalesce(a.coverage, ''), coalesce(b.coverage, '')) THEN 'complete' WHEN 'partial' IN (coalesce(a.coverage, ''), coalesce(b.coverage, '')) THEN 'partial'
    ELSE coalesce(nullif(b.coverage, ''), a.coverage) END AS coverage,
  coalesce(b.session, a.session) AS session, coalesce(nullif(b.discovered_from, ''), a.discovered_from) AS discovered_from, coalesce(a.identity, b.identity) AS identity
FROM ({_A}) a FULL JOIN ({_B}) b USING (domain)""",
}
