"""Streams over the given tables, run until all of their rows are read, and the schema log that they fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import captures
from ..sources.schema_log import SchemaLog
from ..sources.tables import HAR_ENTRY, SITE_SCHEMA, read_table, scratch_path
from ..streaming import state
from . import views

TTL_DAYS = 30


def schema_stream_state(spark, d):
    """Changes of clients as versions of schemas: what is live once the stream has read all of them."""
    path = f"{d}/client_change[s].parquet"  # a pattern stands for one file as well as for a folder of files
    stream = spark.readStream.schema(read_table(spark, d, "client_changes").schema).parquet(path)
    schemas = stream.select(F.concat(F.lit("c"), "client_id").alias("domain"), F.col("source").alias("id"), F.col("seq").alias("version"), F.col("valid_at").cast("timestamp").alias("created_at"), F.col("city").alias("payload"))
    out = scratch_path(spark, "schema-changes")
    query = state.schema_changes(schemas, TTL_DAYS * 86400).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return state.live_schemas(spark.read.parquet(out)).withColumn("created_at", F.unix_millis("created_at"))


def schema_log_state(spark, d):
    """A log with a commit of inserts, one of updates, a compaction, a drop of all that was deleted, and a commit of the web's updates again."""
    changes = read_table(spark, d, "client_changes").withColumns({"domain": F.concat(F.lit("c"), "client_id"), "id": F.col("source"), "version": F.col("seq").cast("int"), "url_pattern": F.col("city")})
    schema = spark.createDataFrame([], SITE_SCHEMA)
    # of one commit's rows of a schema and version, the least pattern
    put = lambda which: schema.unionByName(changes.filter(which).groupBy("domain", "id", "version").agg(F.min("url_pattern").alias("url_pattern")), allowMissingColumns=True)
    log = SchemaLog(spark, scratch_path(spark, "schema-log"))
    log.upsert(put("op = 'I'"))
    log.upsert(put("op = 'U'"))
    log.compact()
    log.drop(changes.filter("op = 'D'"))
    log.upsert(put("op = 'U' AND source = 'web'"))
    return log.read().select("domain", "id", "version", "url_pattern")


def capture_source_rows(spark, d):
    """All captured entries, written as two batches of captures and read back through the data source."""
    path = scratch_path(spark, "captures")
    rows = spark.createDataFrame([], HAR_ENTRY).unionByName(views.har(spark, d).drop("event_type", "ts").withColumn("ord", F.col("ord").cast("int")), allowMissingColumns=True)
    captures.write_captures(rows.filter("status = 200"), path, 0)
    captures.write_captures(rows.filter("status <> 200"), path, 1)
    return captures.read_captures(spark, path).select("host", "capture_id", "ord", "method", "url", "status", "content_type", "body")


QUERIES = {"capture_source_rows": capture_source_rows, "schema_stream_state": schema_stream_state, "schema_log_state": schema_log_state}
ORACLE_SQL = {
    "capture_source_rows": f"""
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, capture_id, CAST(ord AS INT) AS ord, method, url, status, content_type, body FROM ({views.har_sql()})""",
    "schema_stream_state": f"""
WITH v AS (
  SELECT 'c' || client_id AS domain, source AS id, seq AS version, valid_at AS created_at, city AS payload FROM client_changes
  WHERE client_id IS NOT NULL AND source IS NOT NULL AND seq IS NOT NULL AND valid_at IS NOT NULL
), n AS (SELECT *, row_number() OVER (PARTITION BY domain, id ORDER BY version DESC, created_at DESC, coalesce(payload, '') DESC) AS k FROM v)
SELECT domain, id, version, epoch_ms(created_at) AS created_at, payload FROM n
WHERE k = 1 AND created_at + INTERVAL {TTL_DAYS} DAY > (SELECT max(created_at) FROM v) - INTERVAL 1 HOUR""",
    "schema_log_state": """
WITH c AS (SELECT 'c' || client_id AS domain, source AS id, CAST(seq AS INT) AS version, city AS url_pattern, op FROM client_changes),
g AS (SELECT DISTINCT domain, id FROM c WHERE op = 'D'),
p AS (
  SELECT domain, id, version, min(url_pattern) AS url_pattern, 1 AS n FROM c WHERE op = 'I' GROUP BY ALL UNION ALL
  SELECT domain, id, version, min(url_pattern), 2 FROM c WHERE op = 'U' GROUP BY ALL UNION ALL
  SELECT domain, id, version, min(url_pattern), 3 FROM c WHERE op = 'U' AND id = 'web' GROUP BY ALL
), l AS (SELECT * FROM p WHERE n = 3 OR NOT EXISTS (SELECT 1 FROM g WHERE g.domain IS NOT DISTINCT FROM p.domain AND g.id IS NOT DISTINCT FROM p.id))
SELECT domain, id, version, url_pattern FROM l QUALIFY row_number() OVER (PARTITION BY domain, id ORDER BY version DESC NULLS LAST, n DESC) = 1""",
}
