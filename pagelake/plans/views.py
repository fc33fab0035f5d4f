"""Derived inputs, written once as SQL that both engines run: captured traffic, schemas and endpoints from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

HAR = """
SELECT user_id AS capture_id, event_id AS ord, CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
  concat('https://h', event_id % 7, '.example.com/', CASE event_type WHEN 'click' THEN 'api/items/' WHEN 'view' THEN 'pixel/' WHEN 'purchase' THEN 'api/orders/'
    WHEN 'signup' THEN 'oauth/' ELSE 'settings/' END, event_id % 5) AS url,
  CASE event_id % 5 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/css' WHEN 2 THEN 'application/GraphQL+JSON' WHEN 3 THEN 'image/png' ELSE 'text/json' END AS content_type,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 500 END ELSE 200 END AS status,
  CASE WHEN event_id % 11 = 0 THEN 'Just a moment... cf_chl_opt' WHEN event_id % 13 = 0 THEN 'Please SIGN IN to continue' ELSE props END AS body,
  event_type, ts
FROM {events}"""

ENDPOINTS = """
SELECT concat('h', o_custkey % 20, '.example.com') AS domain, CASE WHEN o_orderkey % 3 = 0 THEN 'post' ELSE 'GET' END AS method,
  concat('/api/', lower(o_orderstatus), '/', o_orderkey % 40, CASE WHEN o_orderkey % 5 = 0 THEN '?q={q}' ELSE '' END) AS url_template,
  min(CASE WHEN o_orderkey % 7 = 0 THEN 'directJSON' WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('Orders ', o_orderstatus) END) AS name,
  min(CASE WHEN o_orderkey % 2 = 0 THEN concat('List ', o_orderstatus) ELSE '' END) AS description,
  round(max(o_totalprice % 97) / 100.0, 2) AS confidence, max(o_totalprice) > 300000 AS is_primary, CAST(min(o_orderkey) AS INT) AS ord
FROM {orders} WHERE o_orderkey % 2 = PARITY OR o_orderkey % 3 = 1 GROUP BY 1, 2, 3"""

#: What makes one of two inputs of ENDPOINTS.
_SPLIT = " WHERE o_orderkey % 2 = PARITY OR o_orderkey % 3 = 1"


def har(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(HAR, events=read_table(spark, d, "events"))


def endpoints(spark: SparkSession, d: str, parity: int | None = None) -> DataFrame:
    """Endpoints of all orders; with a parity, of one of two inputs that overlap and are to be merged."""
    query = ENDPOINTS.replace(_SPLIT, "") if parity is None else ENDPOINTS.replace("PARITY", str(parity))
    query = query.replace("concat(", "concat_ws('', ")  # DuckDB's concat leaves nulls out, Spark's would make domain and template null
    return spark.sql(query.replace("{q}", "[q]"), orders=read_table(spark, d, "orders"))


def har_sql() -> str:
    return HAR.replace("{events}", "events")


def endpoints_sql(parity: int) -> str:
    return ENDPOINTS.replace("PARITY", str(parity)).replace("{q}", "[q]").replace("{orders}", "orders")
