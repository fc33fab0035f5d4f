"""The schema log: concurrent writers, drops against later puts, compaction, and what an upsert touches."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import functions as F

from pagelake.sources import schema_log, tables


def rows(spark, items):
    made = spark.createDataFrame(items, "domain string, id string, version int, created string").withColumn("created_at", F.to_timestamp("created"))
    return spark.createDataFrame([], tables.SITE_SCHEMA).unionByName(made.drop("created"), allowMissingColumns=True)


def state(log, *domains):
    return {(r.domain, r.id): r.version for r in log.read(list(domains) or None).collect()}


def test_writers_of_one_instant_both_survive(spark, tmp_path):
    log = schema_log.SchemaLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and not state(log, "a.com")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: log.upsert(rows(spark, [(f"{k}.com", "1", 1, "2024-01-31"), ("shared.com", str(k % 2), k, "2024-01-31")])), range(4)))
    assert state(log) == {**{(f"{k}.com", "1"): 1 for k in range(4)}, ("shared.com", "0"): 2, ("shared.com", "1"): 3}
    assert state(log, "2.com", "none.com") == {("2.com", "1"): 1}


def test_drops_hide_what_they_saw(spark, tmp_path):
    log = schema_log.SchemaLog(spark, str(tmp_path / "log"))
    log.upsert(rows(spark, [("a.com", "1", 5, "2024-01-01"), ("a.com", "2", 1, "2024-01-31"), (None, None, None, None)]))
    log.upsert(rows(spark, [("a.com", "1", 4, "2024-01-31")]))
    assert state(log) == {("a.com", "1"): 5, ("a.com", "2"): 1, (None, None): None}
    log.compact()
    log.expire(F.to_timestamp(F.lit("2024-02-01")), 7 * 86400)
    assert state(log) == {("a.com", "2"): 1, (None, None): None}
    log.upsert(rows(spark, [("a.com", "1", 2, "2024-01-31")]))  # a smaller version, put after the drop
    log.invalidate(["2", "unknown"])
    assert state(log) == {("a.com", "1"): 2, (None, None): None}
    log.compact()
    log.compact()
    assert state(log) == {("a.com", "1"): 2, (None, None): None} and state(log, "a.com") == {("a.com", "1"): 2}


def test_commits_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    log = schema_log.SchemaLog(spark, str(tmp_path / "log"))
    log.upsert(rows(spark, [("a.com", "1", 1, "2024-01-31")]))
    real = log._live

    def late(df):
        monkeypatch.setattr(log, "_live", real)
        log.upsert(rows(spark, [("b.com", "1", 1, "2024-01-31")]))
        return real(df)

    monkeypatch.setattr(log, "_live", late)
    log.compact()
    assert state(log) == {("a.com", "1"): 1, ("b.com", "1"): 1}


def test_an_upsert_adds_files_to_its_buckets_only(spark, tmp_path):
    log = schema_log.SchemaLog(spark, str(tmp_path / "log"))
    log.upsert(rows(spark, [(f"{k}.com", "1", 1, "2024-01-31") for k in range(200)]))
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "log", "rows").rglob("*.parquet")}
    log.upsert(rows(spark, [("7.com", "1", 2, "2024-01-31")]))
    after = {p: p.stat().st_mtime_ns for p in Path(tmp_path, "log", "rows").rglob("*.parquet")}
    assert {p: after[p] for p in before} == before
    assert {p.parent.name for p in after if p not in before} == {f"bucket={schema_log.bucket_of('7.com')}"}
    plan = log.read(["7.com"])._jdf.queryExecution().executedPlan().toString()
    assert f"= {schema_log.bucket_of('7.com')})" in plan.partition("PartitionFilters: [")[2].partition("]")[0]


def test_half_a_commit_is_not_seen(spark, tmp_path, monkeypatch):
    log = schema_log.SchemaLog(spark, str(tmp_path / "log"))
    monkeypatch.setattr(log, "_name", lambda *a, **b: None)  # the writer is lost before it names its commit
    log.upsert(rows(spark, [("a.com", "1", 1, "2024-01-31")]))
    assert log.read().count() == 0
