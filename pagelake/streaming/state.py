"""Schemas as keyed state that lapses: the newest version of each (domain, id) until its time to live is over.

State is held by key in the state store and given up by event-time timers, so it is bounded by what is live, and a query that
starts again from its checkpoint goes on where it was. What changes comes out as rows, so a sink has the whole history.

Rules: a greater version replaces the one held, and the clock of its time to live starts at its created_at; an equal or smaller one
changes nothing, so repeated events are no-ops. A schema lapses when the watermark passes created_at + ttl. Events older than
the watermark are late and dropped by Spark; events that are lapsed on arrival change nothing. Rows without domain, id, version or
created_at are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HELD = "version bigint, created_ms bigint, payload string"
CHANGES = "domain string, id string, change string, version bigint, created_ms bigint, payload string, step bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveSchema(StatefulProcessor):
    """One (domain, id): its newest live version."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("schema", HELD)

    def _change(self, key, change: str, held: tuple, step: int) -> Row:
        version, created_ms, payload = held
        return Row(domain=key[0], id=key[1], change=change, version=version, created_ms=created_ms, payload=payload, step=step)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        live = [r for r in rows if r["created_ms"] + self.ttl_ms > watermark]
        if not live:
            return
        best = max(live, key=lambda r: (r["version"], r["created_ms"], r["payload"] or ""))
        old = tuple(self.held.get()) if self.held.exists() else None
        if old and old[1] + self.ttl_ms <= watermark:  # its timer would come after these rows
            self.held.clear()
            yield self._change(key, "lapsed", old, watermark)
        elif old and old[0] >= best["version"]:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best["created_ms"] + self.ttl_ms)
        held = (best["version"], best["created_ms"], best["payload"])
        self.held.update(held)
        yield self._change(key, "stored", held, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.held.exists():
            return
        held = tuple(self.held.get())
        self.held.clear()
        yield self._change(key, "lapsed", held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def schema_changes(schemas: DataFrame, ttl_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """The stream of changes (stored, lapsed) that a stream of schemas (domain, id, version, created_at, payload) makes; step is the
    watermark in milliseconds at which each came about."""
    spark = schemas.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only one with timers
    rows = schemas.select("domain", "id", F.col("version").cast("bigint").alias("version"), "created_at", F.unix_millis("created_at").alias("created_ms"), "payload").dropna(subset=["domain", "id", "version", "created_at"])
    keyed = rows.withWatermark("created_at", lateness).groupBy("domain", "id")
    changes = keyed.transformWithState(LiveSchema(ttl_seconds), CHANGES, "append", "eventTime")
    return changes.select("domain", "id", "change", "version", F.timestamp_millis("created_ms").alias("created_at"), "payload", "step")


def live_schemas(changes: DataFrame) -> DataFrame:
    """What is live after a table of changes: a key's last change, if it was stored. At one watermark a key lapses before it is stored anew,
    and is stored in the order of versions."""
    last = F.max_by(F.struct("change", "version", "created_at", "payload"), F.struct("step", (F.col("change") == "stored").cast("int"), "version"))
    return changes.groupBy("domain", "id").agg(last.alias("last")).filter("last.change = 'stored'").select("domain", "id", "last.version", "last.created_at", "last.payload")
