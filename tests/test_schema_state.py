"""Schemas as state that lapses: restarts, late and repeated events, and the order of changes."""

import datetime as dt

from pyspark.sql import functions as F

from pagelake.streaming import state

ROWS = "domain string, id string, version int, created_at timestamp, payload string"


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def step(spark, path, rows):
    """Adds a file of rows and runs the stream until it is read; the stream goes on from its checkpoint each time."""
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    schemas = spark.readStream.schema(ROWS).parquet(f"{path}/in")
    query = state.schema_changes(schemas, 3600, "10 minutes").writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    query.awaitTermination()
    changes = spark.read.parquet(f"{path}/out")
    live = {(r.domain, r.id): (r.version, r.payload) for r in state.live_schemas(changes).collect()}
    return live, sorted((r.domain, r.change, r.version) for r in changes.collect())


def test_state_lapses_and_outlives_restarts(spark, tmp_path):
    path = str(tmp_path)
    live, _ = step(spark, path, [("a", "1", 1, at(1), "x"), ("b", "1", 1, at(1, 30), "y"), (None, "1", 1, at(1), "z"), ("n", "1", None, at(1), "z")])
    assert live == {("a", "1"): (1, "x"), ("b", "1"): (1, "y")}
    # a repeated event changes nothing, a newer version replaces and starts the clock anew
    live, changes = step(spark, path, [("a", "1", 1, at(1), "again"), ("a", "1", 2, at(1, 40), "x2"), ("a", "1", 2, at(1, 40), "x2")])
    assert live == {("a", "1"): (2, "x2"), ("b", "1"): (1, "y")} and changes == [("a", "stored", 1), ("a", "stored", 2), ("b", "stored", 1)]
    # the watermark comes to 2:35, past 2:30 where b lapses; a row of before it is late
    live, changes = step(spark, path, [("c", "1", 1, at(2, 45), "z"), ("a", "1", 3, at(1, 20), "late")])
    assert live == {("a", "1"): (2, "x2"), ("c", "1"): (1, "z")} and ("b", "lapsed", 1) in changes
    # what lapses with the rows that bring the watermark on is stored anew only by what is live
    live, changes = step(spark, path, [("d", "1", 1, at(5), "q"), ("a", "1", 3, at(3), "short")])
    assert live == {("d", "1"): (1, "q")} and ("a", "lapsed", 3) in changes and ("c", "lapsed", 1) in changes
    live, _ = step(spark, path, [("a", "1", 1, at(5, 5), "an older version, after the state was given up")])
    assert live == {("d", "1"): (1, "q"), ("a", "1"): (1, "an older version, after the state was given up")}


def test_live_schemas_takes_the_last_change(spark):
    rows = [("a", "1", "stored", 2, at(1), "x", 0), ("a", "1", "lapsed", 2, at(1), "x", 50), ("a", "1", "stored", 1, at(3), "y", 50), ("b", "1", "stored", 1, at(1), "z", 7), ("b", "1", "lapsed", 1, at(1), "z", 9)]
    changes = spark.createDataFrame(rows, "domain string, id string, change string, version bigint, created_at timestamp, payload string, step bigint")
    assert [(r.domain, r.version, r.payload) for r in state.live_schemas(changes).collect()] == [("a", 1, "y")]
    assert state.live_schemas(changes.filter(F.lit(False))).count() == 0
