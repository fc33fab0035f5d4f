"""Schema and endpoint rows, maps and small parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import catalog, schemas
from ..sources.tables import read_table
from . import views
from .url_queries import _AUTH, _PATH, _segs, norm_sql


def _urls(spark, d):
    return read_table(spark, d, "pages").select("page_id", "url")


def probe_schema_rows(spark, d):
    asked = catalog.probe_candidates(_urls(spark, d)).filter("strategy <> 'wp_json'")
    return schemas.probe_schemas(asked).select("domain", "id", "url_pattern", "schema_type", "name", "url_template", "confidence")


def rule_schema_rows(spark, d):
    css = schemas.rule_schemas(_urls(spark, d), '{"title":"h1"}').select("domain", "id", "url_pattern", "schema_type")
    return css.unionByName(schemas.next_data_schemas(_urls(spark, d), "{}").select("domain", "id", "url_pattern", "schema_type"))


def endpoint_fill(spark, d):
    rows = views.endpoints(spark, d).withColumn("confidence", F.col("confidence").cast("double"))
    return schemas.endpoint_defaults(rows).select("domain", "url_template", "method", "ord", "description", "confidence")


def entity_types(spark, d):
    name = F.concat(F.element_at(F.array(*map(F.lit, ["Search ", "toplist ", "REPOS of ", "", "my Item "])), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_type"))
    kind = F.when(F.col("p_size") % 2 == 0, "array").when(F.col("p_size") % 3 == 0, "object")
    return read_table(spark, d, "part").select("p_partkey", schemas.entity_type(name, kind).alias("entity"))


def primary_endpoints(spark, d):
    return schemas.primary_endpoint(views.endpoints(spark, d), ["domain"]).select("domain", "ord", "is_primary")


def improved_patterns(spark, d):
    return _urls(spark, d).select("page_id", schemas.improved_pattern(urls.path(F.col("url")), F.array(F.lit("^[a-z]{2}$"), F.lit(r"\.html$"))).alias("pattern"))


def encoded_queries(spark, d):
    params = F.create_map(F.lit("z"), F.col("r_name"), F.lit("a b"), F.lit("{slot}"), F.lit("m"), F.lit("x&y"))
    return read_table(spark, d, "region").select("r_regionkey", schemas.encode_query(params).alias("query"))


def header_override(spark, d):
    base = F.create_map(F.lit("accept"), F.lit("*/*"), F.lit("x-type"), F.lit("base"))
    merged = schemas.overridden(base, F.create_map(F.lit("x-type"), F.col("event_type")))
    return read_table(spark, d, "events").select("event_id", F.try_element_at(merged, F.lit("accept")).alias("accept"), F.try_element_at(merged, F.lit("x-type")).alias("kind"), F.size(merged).alias("n"))


def graphql_types(spark, d):
    types = read_table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("__"), "n_name")).otherwise(F.col("n_name")).alias("name"), F.lit("OBJECT").alias("kind"))
    return schemas.user_types(types)


def store_bodies(spark, d):
    body = F.when(F.col("event_id") % 3 == 0, F.lit('{"products":[1]}')).when(F.col("event_id") % 3 == 1, F.lit('{"products":{"a":1}}')).otherwise(F.col("props"))
    return read_table(spark, d, "events").select("event_id", schemas.is_store(body).alias("store"))


def missing_session_keys(spark, d):
    present = F.create_map(F.lit("sid"), F.lit("1"), F.col("event_type"), F.lit("2"))
    return read_table(spark, d, "events").select("event_id", F.array_join(schemas.missing_keys(F.array(F.lit("sid"), F.lit("view"), F.lit("csrf")), present), ",").alias("missing"))


def hmac_digests(spark, d):
    """Keys of a block and more are hashed first."""
    key = F.when(F.col("n_nationkey") % 2 == 0, F.lit("key")).otherwise(F.repeat(F.lit("k"), F.lit(70)))
    return read_table(spark, d, "nation").select("n_nationkey", schemas.hmac_sha256(key, F.col("n_name")).alias("digest"))


def traffic_documents(spark, d):
    found = schemas.traffic_document(views.har(spark, d))
    return found.select("capture_id", "document")


QUERIES = {f.__name__: f for f in (
    probe_schema_rows, rule_schema_rows, endpoint_fill, entity_types, primary_endpoints, improved_patterns, encoded_queries, header_override,
    graphql_types, store_bodies, missing_session_keys, hmac_digests, traffic_documents,
)}

_NORM = norm_sql(_PATH)
_NEXT = f"""(SELECT page_id, {_AUTH} AS domain, CASE WHEN len({_segs(_PATH)}) > 1
  THEN '/' || array_to_string(list_transform({_segs(_PATH)}, lambda s, i: CASE WHEN i = 1 THEN s ELSE '{{}}' END), '/') ELSE {_NORM} END AS p FROM pages)"""
_ID = "substr(sha256(domain || ':' || p), 1, 16)"

def _pads(key: bytes) -> list[str]:
    """The two key blocks of HMAC-SHA-256 in hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return [bytes(b ^ mask for b in block).hex() for mask in (0x36, 0x5C)]


_INNER, _OUTER = ("CASE WHEN n_nationkey % 2 = 0 THEN unhex('{}') ELSE unhex('{}') END".format(*x) for x in zip(_pads(b"key"), _pads(b"k" * 70)))

ORACLE_SQL = {
    "probe_schema_rows": f"""
SELECT domain, {_ID} AS id, p AS url_pattern, 'api' AS schema_type, name, t AS url_template, CAST(c AS DOUBLE) AS confidence FROM (
  SELECT {_AUTH} AS domain, {_NORM} AS p, 'json_suffix' AS name, rtrim(regexp_replace(url, '[?#].*$', ''), '/') || '.json' AS t, 0.96 AS c FROM pages
  UNION ALL SELECT {_AUTH}, {_NORM}, 'accept_header', url, 0.8 FROM pages)""",
    "rule_schema_rows": f"""
SELECT domain, {_ID} AS id, p AS url_pattern, 'css' AS schema_type FROM (SELECT {_AUTH} AS domain, {_NORM} AS p FROM pages)
UNION ALL SELECT domain, {_ID}, p, 'next_data' FROM {_NEXT}""",
    "endpoint_fill": f"""
SELECT domain, url_template, upper(method) AS method, ord, coalesce(nullif(description, ''), CASE WHEN name = 'directJSON' THEN 'direct json' ELSE lower(nullif(name, '')) END, '') AS description,
  CAST(CASE WHEN confidence > 0 THEN confidence ELSE 0.65 END AS DOUBLE) AS confidence FROM ({views.endpoints_sql(0)}) WHERE ord % 3 = 0""",
    "entity_types": """
SELECT p_partkey, CASE WHEN contains(n, 'search') THEN 'search_results' WHEN contains(n, 'list') THEN 'list'
  WHEN contains(n, 'repo') OR contains(n, 'product') OR contains(n, 'item') THEN 'entity' WHEN p_size % 2 = 0 THEN 'list' ELSE 'object' END AS entity
FROM (SELECT *, lower(['Search ', 'toplist ', 'REPOS of ', '', 'my Item '][p_partkey % 5 + 1] || p_type) AS n FROM part)""",
    "primary_endpoints": f"""
SELECT domain, ord, is_primary FROM ({views.endpoints_sql(1)}) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY is_primary DESC, ord) = 1""",
    "improved_patterns": rf"""
SELECT page_id, '/' || array_to_string(list_transform({_segs(_PATH)}, lambda s: CASE WHEN regexp_matches(s, '{urls.DYNAMIC}') OR regexp_matches(s, '^[a-z]{{2}}$') OR regexp_matches(s, '\.html$') THEN '{{}}' ELSE s END), '/') AS pattern FROM pages""",
    "encoded_queries": "SELECT r_regionkey, 'a+b={slot}&m=x%26y&z=' || replace(r_name, ' ', '+') AS query FROM region",
    "header_override": "SELECT event_id, '*/*' AS accept, event_type AS kind, CAST(2 AS INTEGER) AS n FROM events",
    "graphql_types": "SELECT n_name AS name, 'OBJECT' AS kind FROM nation WHERE n_nationkey % 4 <> 0",
    "store_bodies": "SELECT event_id, event_id % 3 = 0 AS store FROM events",
    "missing_session_keys": "SELECT event_id, CASE WHEN event_type = 'view' THEN 'csrf' ELSE 'csrf,view' END AS missing FROM events",
    "hmac_digests": f"SELECT n_nationkey, sha256({_OUTER} || unhex(sha256({_INNER} || encode(n_name)))) AS digest FROM nation",
    "traffic_documents": f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ord) AS n FROM ({views.har_sql()}) WHERE ord % 4 = 1)
SELECT capture_id, string_agg('## ' || n || '. ' || method || ' ' || url || chr(10) || 'status ' || status || chr(10) || left(body, 20), chr(10) || chr(10) ORDER BY n) AS document
FROM k WHERE n <= 3 GROUP BY capture_id""",
}
