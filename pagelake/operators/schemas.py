"""Rows of schemas and endpoints: built from probes, rules and inferred endpoints; and small parts that go with them."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from .catalog import PROBE_CONFIDENCE

#: Confidence of an endpoint that came without one.
DEFAULT_CONFIDENCE = 0.65
#: Name of a session variable that a setting is read from, and the settings' defaults.
SETTINGS = {"cache_ttl": "30d", "browser_timeout": "20s", "model": "", "proxy": ""}
PREFIX = "PAGELAKE_"


def _schema(kind: str, pattern: Column, coverage: str) -> list[Column]:
    domain = urls.authority(F.col("url"))
    return [
        domain.alias("domain"), urls.schema_id(domain, pattern).alias("id"), pattern.alias("url_pattern"), F.lit(kind).alias("schema_type"),
        F.lit(coverage).alias("coverage"), F.lit(1).alias("version"), F.col("url").alias("discovered_from"),
    ]


def probe_schemas(candidates: DataFrame) -> DataFrame:
    """API schema rows of probe candidates (url, strategy, probe_url), each with its one endpoint."""
    confidence = F.lit(0.0)
    for name, value in PROBE_CONFIDENCE.items():
        confidence = F.when(F.col("strategy") == name, value).otherwise(confidence)
    pattern = urls.normalize_path(urls.path(F.col("url")))
    return candidates.select(
        *_schema("api", pattern, "partial"), F.col("strategy").alias("name"), F.lit("GET").alias("method"), F.col("probe_url").alias("url_template"), confidence.alias("confidence")
    )


def rule_schemas(pages: DataFrame, rules_json: str) -> DataFrame:
    """CSS schema rows of pages that one set of extraction rules reads."""
    return pages.select(*_schema("css", urls.normalize_path(urls.path(F.col("url"))), "partial"), F.lit(rules_json).alias("rules"))


def next_data_schemas(pages: DataFrame, paths_json: str) -> DataFrame:
    """Schema rows of pages with server state: a broad pattern below the first segment, and paths into the state."""
    return pages.select(*_schema("next_data", urls.next_data_pattern(urls.path(F.col("url"))), "partial"), F.lit(paths_json).alias("rules"))


def endpoint_defaults(endpoints: DataFrame) -> DataFrame:
    """Endpoints with method, name, description and confidence filled in where they are missing."""
    method = F.upper(F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")))
    name = F.coalesce(F.nullif("name", F.lit("")), tx.action_name(urls.path(F.col("url_template"))))
    described = F.coalesce(F.nullif("description", F.lit("")), describe_name(name))
    confidence = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(DEFAULT_CONFIDENCE)
    return endpoints.withColumns({"method": method, "name": name, "description": described, "confidence": confidence})


def describe_name(name: Column) -> Column:
    """listOrders or list_orders as list orders."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")))


def entity_type(name: Column, response_type: Column | None = None) -> Column:
    """What an endpoint returns, by its name, else by the type of its response."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(low.contains("search"), "search_results")
        .when(low.contains("list"), "list")
        .when(low.rlike("repo|product|item"), "entity")
        .when(F.coalesce(response_type, F.lit("")) == "array" if response_type is not None else F.lit(False), "list")
        .otherwise("object")
    )


def primary_endpoint(endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's primary endpoint, the first one if none is marked; one without an ord only if there is no other."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("is_primary", F.lit(False))), F.asc_nulls_last("ord"))
    return endpoints.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def improved_pattern(path: Column, variable_patterns: Column) -> Column:
    """The path with {} for each segment that one of the variables' patterns fits, and for dynamic ones."""
    hit = lambda s: F.exists(variable_patterns, lambda p: F.regexp_like(s, p))
    return F.concat(F.lit("/"), F.array_join(F.transform(urls.segments(path), lambda s: F.when(urls.is_dynamic(s) | hit(s), "{}").otherwise(s)), "/"))


def encode_query(params: Column) -> Column:
    """A map as a query in key order, escaped, with {placeholders} left as they are."""
    one = lambda v: F.when(v.rlike(r"^\{\w+\}$"), v).otherwise(F.url_encode(v))
    return F.array_join(F.transform(F.array_sort(F.map_keys(params)), lambda k: F.concat(F.url_encode(k), F.lit("="), one(F.try_element_at(params, k)))), "&")


def overridden(base: Column, override: Column) -> Column:
    """Both maps' entries, the override's where both have a key."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(override), k)), override)


def user_types(types: DataFrame, full: bool = False) -> DataFrame:
    """GraphQL types (name, kind) without the introspection's own, unless all are asked for."""
    return types if full else types.filter(~F.col("name").startswith("__"))


def is_store(body: Column) -> Column:
    """Whether a JSON body has a list of products, as store fronts answer."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.products", "variant")).startswith("ARRAY"), F.lit(False))


def missing_keys(required: Column, present: Column) -> Column:
    return F.array_sort(F.array_except(required, F.map_keys(present)))


def hmac_sha256(key: Column, message: Column) -> Column:
    """Hex HMAC-SHA-256 of texts; null if either is."""
    raw = key.cast("binary")
    block = F.rpad(F.hex(F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)), 128, "0")
    byte = lambda i: F.conv(F.substr(block, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    pad = lambda mask: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(mask))), 2, "0")), ""))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def traffic_document(entries: DataFrame, most: int = 25, size: int = 500) -> DataFrame:
    """One text per capture that lists its first entries: method, URL, status and the start of the body."""
    order = Window.partitionBy("capture_id").orderBy("ord")
    kept = entries.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most)
    line = F.concat_ws("\n", F.format_string("## %d. %s %s", "__n", "method", "url"), F.concat(F.lit("status "), F.col("status").cast("string")), tx.cut_bytes(F.coalesce("body", F.lit("")), size))
    return kept.withColumn("line", line).groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("__n", "line"))).alias("l")).select(
        "capture_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("document")
    )


def settings(file: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings: the environment before the file before the defaults; blank values count as absent."""
    environment = os.environ if environment is None else environment
    sources = lambda k: (environment.get(PREFIX + k.upper()), (file or {}).get(k))
    return {k: next((v for v in sources(k) if v and v.strip()), default) for k, default in SETTINGS.items()}
