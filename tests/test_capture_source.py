"""The captures data source: the batch reader's rows, pushed filters, pieces of files, streams over batches."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelake.sources import captures, tables


def entries(spark, rows):
    return spark.createDataFrame([(c, o, "GET", u, {"a": "b"}, None, 200, "OK", "application/json", {}, b) for c, o, u, b in rows], tables.HAR_ENTRY)


@pytest.fixture
def path(spark, tmp_path):
    captures.register(spark)
    rows = [(1, k, f"https://h{k % 7}.example.com/p/{k}", '{"n": "%s"}' % ("é\n" * k)) for k in range(60)] + [(2, 0, None, None), (2, 1, "https://h1.example.org/x", "")]
    captures.write_captures(entries(spark, rows), str(tmp_path / "c"), 0)
    return str(tmp_path / "c")


def plain(df):
    return sorted(df.select("host", "capture_id", "ord", "url", "status", "body", F.to_json("req_headers").alias("h")).collect(), key=repr)


def test_rows_are_those_of_the_json_reader(spark, path):
    wanted = spark.read.schema(captures.CAPTURE).json(path)
    found = captures.read_captures(spark, path)
    assert plain(found) == plain(wanted) and found.count() == 62
    for split in (67, 1000):
        assert plain(captures.read_captures(spark, path, split)) == plain(wanted)


def test_host_filters_read_fewer_partitions(spark, path):
    found = captures.read_captures(spark, path)
    every = found.rdd.getNumPartitions()
    for which, hosts in ((F.col("host") == "h1.example.com", {"h1.example.com"}), (F.col("host").isin("h2.example.com", "h1.example.org", "none"), {"h2.example.com", "h1.example.org"}), (F.col("host").endswith(".org"), {"h1.example.org"}), (F.col("host").eqNullSafe(None), {None})):
        kept = found.filter(which)
        assert {r.host for r in kept.collect()} == hosts
        assert 0 < kept.rdd.getNumPartitions() < every / 2
        assert found.count() == 62  # the same table without the filter
    assert found.filter("host = 'none'").count() == 0 and found.filter("batch >= 1").count() == 0 and found.filter("batch = 0").count() == 62
    # other filters stay with Spark
    assert found.filter((F.col("host") == "h1.example.com") & (F.col("ord") > 30)).count() == sum(k % 7 == 1 and k > 30 for k in range(60))
    assert found.filter((F.col("host") == "h1.example.com") | (F.col("ord") == 2)).count() == sum(k % 7 == 1 or k == 2 for k in range(60))


def test_broken_lines_and_half_written_batches(spark, path):
    folder = Path(path, f"batch={3:012d}", "host=x.com")
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text('not json\n\n[1]\n{"ord": 9, "status": 404}')
    found = captures.read_captures(spark, path)
    assert found.count() == 62
    Path(path, f"batch={3:012d}", "_SUCCESS").touch()
    assert sorted((r.ord, r.status) for r in found.filter("host = 'x.com'").collect() if r.ord) == [(9, 404)]
    assert captures.read_captures(spark, path).filter("host = 'x.com'").count() == 3


def test_stream_reads_each_batch_once(spark, path, tmp_path):
    def run():
        query = spark.readStream.format("captures").load(path).select("host", "ord").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 62 and run() == 62
    captures.write_captures(entries(spark, [(5, 5, "https://new.com/", "x")]), path, 4)
    assert run() == 63
    assert json.loads(Path(str(tmp_path / "k"), "offsets", "1").read_text().splitlines()[-1]) == {"batch": 5}
