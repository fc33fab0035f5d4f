"""Streams of captured traffic: request-response joins, learnt domains, upserts into a schema store.

Request and response streams join by id with watermarks; a request without an answer within the bound comes out with
empty response columns. State is bounded by the watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..sources.tables import SchemaStore


def join_streams(requests: DataFrame, responses: DataFrame, wait: str = "30 seconds") -> DataFrame:
    """requests (request_id, ts, ...) with their responses (request_id, ts, ...) of at most `wait` later."""
    left = requests.withColumnRenamed("ts", "request_ts").withWatermark("request_ts", wait)
    right = responses.select(F.col("request_id").alias("__id"), *[c for c in responses.columns if c != "request_id"]).withColumnRenamed("ts", "response_ts").withWatermark("response_ts", wait)
    within = F.expr(f"__id = request_id and response_ts >= request_ts and response_ts <= request_ts + interval {wait}")
    return left.join(right, within, "left_outer").drop("__id")


def learn_domains(pages: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Each bare host once in a horizon, as it is first seen."""
    return pages.withColumn("domain", urls.bare_host(F.col("url"))).withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["domain"]).select("domain", "ts")


def upsert_stream(schemas: DataFrame, store: SchemaStore, checkpoint: str, seen: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Writes every batch of schemas into the store and tells `seen` of it; a repeated batch leaves the same state."""

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(batch)
        if seen is not None:
            seen(batch)

    return schemas.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
