import json

import pytest
from pyspark.sql import functions as F

from pagelake.sources import tables
from pagelake.streaming import captures

def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def schema_rows(spark, rows):
    base = "domain string, id string, url_pattern string, schema_type string, version int, created string, discovered_from string"
    made = spark.createDataFrame(rows, base).withColumn("created_at", F.to_timestamp("created"))
    full = spark.createDataFrame([], tables.SITE_SCHEMA)
    return full.unionByName(made.drop("created"), allowMissingColumns=True)


def test_store(spark, tmp_path):
    store = tables.SchemaStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    store.upsert(schema_rows(spark, [("a.com", "1", "/x/{}", "api", 1, "2024-01-31", "https://a.com/x/1"), ("b.com", "2", "/y", "css", 1, "2023-01-01", "https://b.com/y")]))
    store.upsert(schema_rows(spark, [("a.com", "1", "/x/{}", "api", 2, "2024-01-31", "https://a.com/x/1")]))
    assert {(r.id, r.version) for r in store.read().collect()} == {("1", 2), ("2", 1)}
    store.store_if_no_api(schema_rows(spark, [("a.com", "3", "/x/{}", "css", 1, "2024-01-31", "https://a.com/x/7"), ("c.com", "4", "/z", "css", 1, "2024-01-31", "https://c.com/z")]), now(), 30 * 86400)
    assert {r.id for r in store.read().collect()} == {"1", "2", "4"}
    store.expire(now(), 30 * 86400)
    store.invalidate(["4", "unknown"])
    assert {r.id for r in store.read().collect()} == {"1"}
    with pytest.raises(ValueError):
        store.clear("../a")
    store.clear("a.com")
    assert store.read().count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>x</title>\nmore")
    assert spark.createDataFrame([("x",)], "s string").count() and tables.read_html_files(spark, str(tmp_path / "a.html")).first().html.endswith("more")
    (tmp_path / "d.txt").write_text("# list\nA.com\n\na.com\nb.org\n")
    assert {r.domain for r in tables.read_domains(spark, str(tmp_path / "d.txt")).collect()} == {"a.com", "b.org"}
    (tmp_path / "h.json").write_text(json.dumps({"capture_id": 1, "ord": 2, "url": "u", "resp_headers": {"a": "b"}}))
    har = tables.read_har_lines(spark, str(tmp_path / "h.json"))
    tables.write_har_lines(har, str(tmp_path / "out"))
    assert tables.read_har_lines(spark, str(tmp_path / "out")).first().resp_headers == {"a": "b"}
    answers = spark.createDataFrame([(200, "application/json", '{"a":1,"b":2}'), (200, "application/json", '{"a":1}'), (500, "application/json", '{"a":1,"b":2}'), (200, "text/html", "{}")], "status int, content_type string, body string")
    assert tables.json_probes(answers).count() == 1 and tables.successful(answers, 3).first().body == '{"a'


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:05", "b")], "request_id int, t string, url string").selectExpr("request_id", "to_timestamp(t) ts", "url").write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(1, "2024-01-01 00:00:03", 200), (9, "2024-01-01 00:05:00", 200)], "request_id int, t string, status int").selectExpr("request_id", "to_timestamp(t) ts", "status").write.parquet(str(tmp_path / "r"))
    asked = spark.readStream.schema("request_id int, ts timestamp, url string").parquet(str(tmp_path / "q"))
    answers = spark.readStream.schema("request_id int, ts timestamp, status int").parquet(str(tmp_path / "r"))
    query = captures.join_streams(asked, answers).writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.request_id, r.status) for r in spark.table("joined").filter("status is not null").collect()] == [(1, 200)]
    pages = spark.readStream.schema("request_id int, ts timestamp, url string").parquet(str(tmp_path / "q")).withColumn("url", F.lit("https://www.A.com/x"))
    query = captures.learn_domains(pages).writeStream.format("memory").queryName("domains").option("checkpointLocation", str(tmp_path / "d")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.domain for r in spark.table("domains").collect()] == ["a.com"]
