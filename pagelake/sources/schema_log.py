"""Site schemas as a log of commits that is merged on read.

A write appends its rows, in the buckets of their domains, and then its own line to the list of commits; nothing is rewritten, so writers
of one instant do not lose each other's rows, and a reader sees whole commits only. A drop names the commits that it has seen of a
schema, so what another writer puts meanwhile stays. compact() writes the merged state as a new base, with the list of commits that it holds;
readers take the newest base and the commits that it does not hold. Readers of some domains read their buckets only.
"""

from __future__ import annotations

import time
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import SITE_SCHEMA

BUCKETS = 64
#: Beside the columns of a schema: its bucket, whether it is put or dropped, its commit, and the commits that a drop has seen.
LOGGED = "bucket int, put boolean, commit string, at bigint, seen array<string>"


def bucket_of(domain: str) -> int:
    return zlib.crc32(domain.encode()) % BUCKETS


class SchemaLog:
    def __init__(self, spark: SparkSession, path: str, schema: str = SITE_SCHEMA):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T._parse_datatype_string(schema)
        self.logged = T.StructType([*self.schema.fields, *T._parse_datatype_string(LOGGED).fields])

    def _table(self, name: str, schema: T.StructType | str) -> DataFrame:
        """A table of the log; without rows where nothing was written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _name(self, name: str, at: int) -> None:
        """Makes what was written under this name count."""
        self.spark.range(1).select(F.lit(at).alias("at")).coalesce(1).write.parquet(f"{self.path}/{name}")

    def _commit(self, rows: DataFrame) -> str:
        commit, at = f"c{uuid.uuid4().hex}", time.time_ns()
        bucket = F.pmod(F.crc32(F.coalesce("domain", F.lit(""))), F.lit(BUCKETS)).cast("int")
        rows = rows.select(*self.schema.names, "put", "seen").withColumns({"bucket": bucket, "at": F.lit(at)})
        # a folder for each commit: writers share no output folder, and readers leave out whole commits
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/commit={commit}")
        self._name(f"commits/commit={commit}", at)
        return commit

    def _generation(self) -> str | None:
        newest = self._table("bases", "at bigint, base string").orderBy(F.desc("at"), "base").limit(1).collect()
        return newest[0]["base"] if newest else None

    def _rows(self, domains: list[str] | None = None) -> DataFrame:
        """All puts and drops that count: those of the newest base and of later whole commits."""
        wanted = lambda df: df if domains is None else df.filter(F.col("bucket").isin([bucket_of(d) for d in domains]) & F.col("domain").isin(domains))
        rows = wanted(self._table("rows", self.logged)).join(self._table("commits", "at bigint, commit string").select("commit"), "commit", "left_semi")
        if base := self._generation():
            rows = rows.join(self._table(f"held/{base}", "commit string"), "commit", "left_anti")
            rows = rows.select(*self.logged.names).unionByName(wanted(self._table(f"base/{base}", self.logged)))
        return rows.select(*self.logged.names)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Each schema's newest put, by version and then commit, that no drop has seen."""
        schema = Window.partitionBy("domain", "id")
        hidden = F.flatten(F.collect_list(F.when(~F.col("put"), F.col("seen"))).over(schema))
        puts = rows.withColumn("hidden", hidden).filter(F.col("put") & ~F.array_contains("hidden", F.col("commit"))).drop("hidden")
        nth = F.row_number().over(schema.orderBy(F.desc_nulls_last("version"), F.desc("at"), "commit"))
        return puts.withColumn("nth", nth).filter("nth = 1").drop("nth")

    def read(self, domains: list[str] | None = None) -> DataFrame:
        return self._live(self._rows(domains)).select(*self.schema.names)

    def upsert(self, schemas: DataFrame) -> str:
        """Puts schemas; the newest version of each (domain, id) counts, the later commit of equal ones. Returns the commit."""
        return self._commit(schemas.withColumns({"put": F.lit(True), "seen": F.lit(None).cast("array<string>")}))

    def drop(self, which: Column | DataFrame) -> str:
        """Drops the schemas that a condition holds for, or whose (domain, id) a table names; unknown ones are no fault."""
        rows = self._rows()
        chosen = self._live(rows).filter(which) if isinstance(which, Column) else which
        seen = rows.filter("put").groupBy("domain", "id").agg(F.collect_set("commit").alias("seen"))
        keys = chosen.select("domain", "id").distinct()
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("domain", "id")]
        found = seen.alias("s").join(keys.alias("k"), same, "left_semi")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in ("domain", "id")]
        return self._commit(found.select("domain", "id", *empty, F.lit(False).alias("put"), "seen"))

    def invalidate(self, ids: list[str]) -> str:
        return self.drop(F.col("id").isin(ids))

    def expire(self, now: Column, ttl_seconds: int) -> str:
        return self.drop(F.unix_timestamp(now) - F.unix_timestamp("created_at") > ttl_seconds)

    def compact(self) -> str:
        """Writes the merged state as the new base. Commits that come meanwhile are not in it, and are read beside it."""
        base, at = f"b{uuid.uuid4().hex}", time.time_ns()
        self._table("commits", "at bigint, commit string").select("commit").distinct().write.parquet(f"{self.path}/held/{base}")
        held = self._table(f"held/{base}", "commit string")
        # only what the list holds goes into the base
        old = self._generation()
        rows = self._table("rows", self.logged).join(held, "commit", "left_semi")
        if old:
            rows = rows.join(self._table(f"held/{old}", "commit string"), "commit", "left_anti").select(*self.logged.names).unionByName(self._table(f"base/{old}", self.logged))
        live = self._live(rows.select(*self.logged.names)).select(*self.logged.names)
        live.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/base/{base}")
        self._name(f"bases/base={base}", at)
        return base
