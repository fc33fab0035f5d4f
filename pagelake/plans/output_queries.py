"""Outputs and small text parts: replay bodies, probe filters, key tests, JSON shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, extract, structured, traffic
from ..sources import tables
from ..sources.tables import read_table
from . import views


def replay_bodies(spark, d):
    shown = traffic.replay_body(F.col("body"), 20)
    return views.har(spark, d).select("ord", shown.alias("r")).select("ord", F.col("r.json").alias("json"), F.col("r.text").alias("text"), "r.body_truncated")


def json_probe_filter(spark, d):
    body = F.when(F.col("ord") % 3 == 0, F.concat(F.lit('{"a":'), F.col("ord").cast("string"), F.lit(',"b":{"c":1}}'))).otherwise(F.col("body"))
    return tables.json_probes(views.har(spark, d).withColumn("body", body)).select("ord", "n_keys")


def successful_responses(spark, d):
    return tables.successful(views.har(spark, d), 12).select("ord", "body")


def query_key_kinds(spark, d):
    keys = F.array(*map(F.lit, ["q", "Search-Term", "token", "page", "Page_Num", "lang", "id"]))
    rows = read_table(spark, d, "region").select("r_regionkey", F.explode(keys).alias("key"))
    return rows.select("r_regionkey", "key", catalog.is_search_key(F.col("key")).alias("searches"), catalog.is_page_key(F.col("key")).alias("pages"))


def text_parts(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    size = F.pow(F.lit(7.0), F.col("event_id") % 22).cast("bigint") + F.col("event_id")
    return read_table(spark, d, "events").select(
        "event_id", tx.strip_fence(fenced).alias("plain"), tx.first_non_blank(F.lit("  "), F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.lit("none")).alias("first"),
        tx.human_bytes(size).alias("size"),
    )


def body_lines(spark, d):
    line = F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, " Please wait").otherwise(""))
    return read_table(spark, d, "documents").select("doc_id", (tx.clean_body(tx.collapse_whitespace(line)) == "").alias("dropped"))


def page_json(spark, d):
    found = structured.shape_output(extract.extract_pages(read_table(spark, d, "pages"), ("title", "language", "has_article", "meta")))
    return found.select("page_id", F.get_json_object("json", "$.language").alias("language"), F.get_json_object("json", "$.meta").alias("meta"), F.get_json_object("json", "$.has_article").alias("article"))


QUERIES = {f.__name__: f for f in (replay_bodies, json_probe_filter, successful_responses, query_key_kinds, text_parts, body_lines, page_json)}

_HAR = views.har_sql()
_NOISE = " OR ".join(f"contains(lower(t), '{p}')" for p in tx.NOISE_PHRASES)

ORACLE_SQL = {
    "replay_bodies": f"""
SELECT ord, CASE WHEN json_valid(body) THEN body END AS json, CASE WHEN NOT json_valid(body) THEN left(body, 20) END AS text,
  NOT json_valid(body) AND strlen(body) > 20 AS body_truncated FROM ({_HAR})""",
    "json_probe_filter": f"""
SELECT ord, CAST(3 AS INTEGER) AS n_keys FROM ({_HAR}) WHERE ord % 3 = 0 AND status = 200 AND contains(lower(content_type), 'json')""",
    "successful_responses": f"SELECT ord, left(body, 12) AS body FROM ({_HAR}) WHERE status BETWEEN 200 AND 299",
    "query_key_kinds": """
SELECT r_regionkey, key, searches, pages FROM region, (VALUES ('q', true, false), ('Search-Term', true, false), ('token', true, false), ('page', false, true),
  ('Page_Num', false, true), ('lang', false, false), ('id', false, false)) AS v(key, searches, pages)""",
    "text_parts": """
SELECT event_id, props AS plain, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS first,
  CASE WHEN k = 0 THEN n || 'B' ELSE printf('%.1f', n / pow(1024.0, k)) || substr('KMGTPE', k, 1) || 'B' END AS size
FROM (SELECT *, CAST(len(list_filter(range(1, 7), lambda i: n >= CAST(pow(1024.0, i) AS BIGINT))) AS INTEGER) AS k FROM (SELECT *, CAST(pow(7.0, event_id % 22) AS BIGINT) + event_id AS n FROM events))""",
    "body_lines": rf"""
SELECT doc_id, strlen(t) < 3 OR ({_NOISE}) AS dropped FROM (
  SELECT doc_id, trim(regexp_replace(text || CASE WHEN doc_id % 5 = 0 THEN ' Please wait' ELSE '' END, '[\s\p{{Z}}\x0B\x85]+', ' ', 'g')) AS t FROM documents)""",
    "page_json": "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language, CAST(NULL AS VARCHAR) AS meta, CAST(contains(html, '<article') AS VARCHAR) AS article FROM pages",
}
