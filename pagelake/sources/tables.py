"""Readers of captured data: pages, responses, HAR lines, text lists; and the schema store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cut_bytes

MAX_RESPONSE, MAX_PROBE = 10 << 20, 2 << 20

HAR_ENTRY = (
    "capture_id bigint, ord int, method string, url string, req_headers map<string,string>, req_body string, status int, status_text string, "
    "content_type string, resp_headers map<string,string>, body string"
)
SITE_SCHEMA = (
    "domain string, id string, site string, url_pattern string, schema_type string, coverage string, version int, created_at timestamp, "
    "discovered_from string, endpoints array<struct<name:string,description:string,method:string,url_template:string,confidence:double,is_primary:boolean>>, rules string"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. Where that is unset, in a temporary one of this machine, if
    all executors run in this process; else an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagelake-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """One page per file: its path as url and its text as html."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def read_har_lines(spark: SparkSession, path: str) -> DataFrame:
    """HAR entries from line-delimited JSON."""
    return spark.read.schema(HAR_ENTRY).json(path)


def write_har_lines(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domains of a list file; blank lines and # comments are left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("domain")).filter("domain <> '' and not startswith(domain, '#')").distinct()


def successful(responses: DataFrame, size: int = MAX_RESPONSE) -> DataFrame:
    """Responses of status 200 to 299, bodies cut to size bytes."""
    return responses.filter(F.col("status").between(200, 299)).withColumn("body", cut_bytes(F.col("body"), size))


def json_probes(responses: DataFrame) -> DataFrame:
    """Responses of status 200 and a JSON type, of at most 2 MB, whose body is JSON with two keys at least to depth 2."""
    from ..functions.jsons import count_keys_column

    kept = responses.filter((F.col("status") == 200) & F.lower("content_type").contains("json") & (F.octet_length("body") <= MAX_PROBE))
    return kept.withColumn("n_keys", count_keys_column(F.col("body"), 2)).filter("n_keys >= 2")


class SchemaStore:
    """Site schemas as a Parquet table partitioned by domain; every write makes a new version of the table and then names it.

    The name is a one-row table beside the versions, so that a reader sees the old or the new state, never a mixture.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _current(self) -> str | None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/names").orderBy(F.desc("at")).limit(1).collect()
        except Exception as error:  # no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return rows[0]["version"] if rows else None

    def read(self) -> DataFrame:
        version = self._current()
        if version is None:
            return self.spark.createDataFrame([], SITE_SCHEMA)
        return self.spark.read.schema(SITE_SCHEMA).parquet(f"{self.path}/{version}")

    def _replace(self, schemas: DataFrame) -> None:
        version = uuid.uuid4().hex
        schemas.repartition("domain").write.partitionBy("domain").parquet(f"{self.path}/{version}")
        name = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
        name.coalesce(1).write.mode("append").parquet(f"{self.path}/names")

    def upsert(self, schemas: DataFrame) -> None:
        from ..operators.catalog import upsert

        self._replace(upsert(self.read(), schemas.select(*self.read().columns)))

    def store_if_no_api(self, schemas: DataFrame, now: Column, ttl_seconds: int) -> None:
        """Stores schemas whose discovered_from no live API schema matches."""
        from ..operators.catalog import lookup

        stored = self.read().withColumn("ord", F.xxhash64("domain", "id"))
        covered = lookup(schemas.select(F.col("discovered_from").alias("url")).distinct(), stored, now, ttl_seconds).filter("bucket = 'api'")
        self.upsert(schemas.join(covered.select(F.col("url").alias("discovered_from")), "discovered_from", "left_anti"))

    def invalidate(self, ids: list[str]) -> None:
        """Drops the schemas of these ids in all domains; unknown ids are no fault."""
        self._replace(self.read().filter(~F.col("id").isin(ids)))

    def expire(self, now: Column, ttl_seconds: int) -> None:
        self._replace(self.read().filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl_seconds))

    def clear(self, domain: str | None = None) -> None:
        """Drops one domain's schemas, or all; a name that is no plain domain is refused."""
        if domain is not None and (not domain or set(domain) & set("/\\") or ".." in domain):
            raise ValueError(f"not a domain: {domain!r}")
        self._replace(self.read().filter(F.lit(False) if domain is None else F.col("domain") != domain))
