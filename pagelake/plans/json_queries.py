"""JSON paths, jq programs, inference and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jq_columns, jsons, semantics, urls
from ..sources.tables import read_table

_EVENT = """concat('{"id":', event_id, ',"type":"', event_type, '","user":{"id":', user_id, ',"tags":["a', event_id % 3, '","b"]},"items":[{"n":', event_id % 5, '},{"n":', event_id % 7, '}]}')"""


def _events(spark, d):
    return read_table(spark, d, "events").selectExpr("event_id", "props", f"{_EVENT} AS body")


def json_path(spark, d):
    return _events(spark, d).select("event_id", jsons.get_path(F.col("props"), ".k").alias("k"), jsons.get_path(F.col("body"), ".user.tags[0]").alias("tag"), jsons.get_path(F.col("body"), ".no.such").alias("none"))


def json_project(spark, d):
    found = jsons.project_paths(F.col("body"), {"kind": ".type", "missing": ".zzz", "second": ".items[1].n"})
    return _events(spark, d).select("event_id", F.try_element_at(found, F.lit("kind")).alias("kind"), F.try_element_at(found, F.lit("second")).alias("second"), F.size(found).alias("n"))


def json_iterate(spark, d):
    return jsons.query_json(_events(spark, d), "body", ".items[]").select("event_id", F.get_json_object("result", "$.n").alias("n"))


def json_jq(spark, d):
    return jsons.query_json(_events(spark, d), "body", ".items[] | select(.n > 3) | .n").select("event_id", "result")


#: Bodies of four shapes, by event: the whole one, an empty list, flat values, and a broken one.
_SHAPES = f"""CASE event_id % 4 WHEN 0 THEN {_EVENT} WHEN 1 THEN '[]' WHEN 2 THEN concat('{{"b":', event_id % 3 = 0, ',"a":null}}') ELSE '{{"a":' END"""


def _shapes(spark, d):
    return read_table(spark, d, "events").selectExpr("event_id", f"{_SHAPES} AS body")


def json_jq_columns(spark, d):
    """Iteration, selection and construction of objects over all events, compiled to columns."""
    found = jq_columns.query_columns(_events(spark, d), "body", '.items[] | select(.n >= 2) | {n, "more": .none}')
    return found.select("event_id", F.get_json_object("result", "$.n").alias("n"), "result")


def json_schema_infer(spark, d):
    return _shapes(spark, d).select(jsons.infer_schema_column(F.col("body")).alias("schema")).groupBy("schema").agg(F.count(F.lit(1)).alias("n"))


def json_truncate(spark, d):
    """Texts of up to 24 bytes cut to 10, lists of up to 5 items to 3."""
    items = F.array_join(F.slice(F.array(*map(F.lit, "12345")), 1, (F.col("event_id") % 6).cast("int")), ",")
    body = F.concat(F.lit('{"t":"'), F.repeat(F.lit("x"), (F.col("event_id") % 25).cast("int")), F.lit('","l":['), items, F.lit("]}"))
    return _events(spark, d).select("event_id", jsons.truncate_column(body, 10).alias("short"))


def json_keytree(spark, d):
    return _shapes(spark, d).select(F.explode(jsons.key_tree_column(F.col("body"))).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


def json_repair(spark, d):
    """Objects and lists open to a depth of the event's own, and a text or a number in the midst of them."""
    depth = (F.col("event_id") % 5).cast("int")
    cut = F.concat(F.repeat(F.lit('{"k":['), depth), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"a]}'), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string")))
    return _events(spark, d).select("event_id", jsons.repair_column(cut).alias("fixed"))


def json_count_keys(spark, d):
    """Objects of up to five keys with three below each, the whole body, lists of lists, and broken texts."""
    keys = F.array_join(F.transform(F.slice(F.array(*map(F.lit, "abcde")), 1, (F.col("event_id") % 6).cast("int")), lambda k: F.concat(F.lit('"'), k, F.lit('":{"x":1,"y":{"z":2}}'))), ",")
    body = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{"), keys, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.col("body")).when(F.col("event_id") % 4 == 2, F.lit('[[{"a":1},{"b":1}]]')).otherwise(F.lit('{"a":'))
    return _events(spark, d).select("event_id", jsons.count_keys_column(body, 2).alias("n_keys"))


def json_leaf_score(spark, d):
    """Each event's body (every seventh is broken) against a target URL of its own."""
    rows = read_table(spark, d, "events").selectExpr("event_id", "event_type", "user_id", f"{_EVENT} AS whole")
    case, at = F.col("event_id") % 6, lambda *parts: F.concat(F.lit("https://x.example/"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    target = (
        F.when(case == 0, at("u/", F.col("event_type"))).when(case == 1, at("u/big-", F.col("event_type"), "?id=", F.col("user_id")))
        .when(case == 2, at("u/zzz?tag=b")).when(case == 3, at("b/")).when(case == 4, at("")).otherwise(at("none?id=", F.col("event_id") + 1))
    )
    body = F.when(F.col("event_id") % 7 == 0, F.left("whole", F.lit(20))).otherwise(F.col("whole"))
    return rows.select("event_id", semantics.semantic_score(target, F.lit("https://api.example/x"), body).cast("double").alias("score"))


def search_state_urls(spark, d):
    url = F.concat(F.lit("https://www.homes.example/"), F.regexp_replace(F.initcap("r_name"), " ", "-"), F.lit("-TX/rentals/"))
    made = urls.search_state_url(url, ("www.homes.example",))
    return read_table(spark, d, "region").select("r_regionkey", made.alias("url"))


QUERIES = {f.__name__: f for f in (
    json_path, json_project, json_iterate, json_jq, json_jq_columns, json_schema_infer, json_truncate, json_keytree, json_repair, json_count_keys, json_leaf_score,
    search_state_urls,
)}

_SCHEMA = (
    '{"fields":[{"name":"id","type":"number"},{"items":{"fields":[{"name":"n","type":"number"}],"type":"object"},"name":"items","type":"array"},'
    '{"name":"type","type":"string"},{"fields":[{"name":"id","type":"number"},{"items":{"type":"string"},"name":"tags","type":"array"}],"name":"user","type":"object"}],"type":"object"}'
)
_TREE = [".id:number", ".items:array", ".items[]:object", ".items[].n:number", ".type:string", ".user:object", ".user.id:number", ".user.tags:array", ".user.tags[]:string"]

ORACLE_SQL = {
    "json_path": f"SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(b, '$.user.tags[0]') AS tag, CAST(NULL AS VARCHAR) AS none FROM (SELECT event_id, props, {_EVENT} AS b FROM events)",
    "json_project": "SELECT event_id, event_type AS kind, CAST(event_id % 7 AS VARCHAR) AS second, CAST(2 AS INTEGER) AS n FROM events",
    "json_iterate": f"SELECT event_id, json_extract_string(unnest(CAST(json_extract(b, '$.items') AS JSON[])), '$.n') AS n FROM (SELECT event_id, {_EVENT} AS b FROM events)",
    "json_jq_columns": """SELECT event_id, CAST(n AS VARCHAR) AS n, '{"more":null,"n":' || n || '}' AS result FROM (SELECT event_id, unnest([event_id % 5, event_id % 7]) AS n FROM events) WHERE n >= 2""",
    "json_jq": "SELECT event_id, CAST(n AS VARCHAR) AS result FROM (SELECT event_id, unnest([event_id % 5, event_id % 7]) AS n FROM events) WHERE n > 3",
    "json_schema_infer": f"""
SELECT CASE c WHEN 0 THEN '{_SCHEMA}' WHEN 1 THEN '{{"type":"array"}}' WHEN 2 THEN '{{"fields":[{{"name":"a","type":"null"}},{{"name":"b","type":"boolean"}}],"type":"object"}}' END AS schema, count(*) AS n
FROM (SELECT event_id % 4 AS c FROM events) GROUP BY c""",
    "json_truncate": """
SELECT event_id, '{"l":[' || array_to_string(range(1, least(event_id % 6, 3) + 1), ',') || '],"t":"' || CASE WHEN event_id % 25 > 10 THEN 'xxxxxxxxxx...' ELSE repeat('x', event_id % 25) END || '"}' AS short FROM events""",
    "json_keytree": f"""
SELECT entry, count(*) AS n FROM (
  SELECT unnest(CASE event_id % 4 WHEN 0 THEN {_TREE} WHEN 2 THEN ['.a:null', '.b:boolean'] END) AS entry FROM events) GROUP BY entry""",
    "json_repair": """
SELECT event_id, repeat('{"k":[', event_id % 5) || CASE WHEN event_id % 2 = 0 THEN '"a]}' || event_id || '"' ELSE '' || event_id END || repeat(']', event_id % 5) || repeat('}', event_id % 5) AS fixed FROM events""",
    "json_count_keys": "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 3 * (event_id % 6) WHEN 1 THEN 7 WHEN 2 THEN 1 END AS INTEGER) AS n_keys FROM events",
    "json_leaf_score": """
SELECT event_id, CAST(CASE WHEN event_id % 6 = 4 THEN 0.6 WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 6 = 1 THEN 0.96 WHEN event_id % 6 = 2 THEN 0.94
  WHEN event_id % 6 = 5 THEN CASE WHEN user_id = event_id + 1 THEN 0.96 ELSE 0 END ELSE 0.84 END AS DOUBLE) AS score FROM events""",
    "search_state_urls": r"""
SELECT r_regionkey, 'https://www.homes.example/' || replace(name, ' ', '-') || '-TX/rentals/?searchQueryState=%7B%22usersSearchTerm%22%3A%22' || replace(name, ' ', '+') || '+TX%22%7D' AS url
FROM (SELECT r_regionkey, array_to_string(list_transform(string_split(r_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM region)""",
}
