"""Endpoint checks and joins: body validity, validation results, parameters, pagination links, bot gates, whole schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls

#: What error texts of bot gates hold.
GATE_TEXTS = ["http 403", "403 forbidden", "status 403", "perimeterx", "datadome", "cloudflare", "captcha", "access denied", "x-bogus", "bot detect"]
#: Fixed value: bytes of a body that are looked at.
BODY_BYTES = 64 * 1024


def is_gate_text(message: Column) -> Column:
    """Whether an error text looks like that of a bot gate; null does not."""
    return F.coalesce(tx.contains_any(F.lower(message), GATE_TEXTS), F.lit(False))


def is_pagination(text: Column, href: Column) -> Column:
    """Whether a link leads to another page: by its text, a page value in its query, or its path's last segment."""
    shown = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    link = F.coalesce(href, F.lit(""))
    path = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    base = F.element_at(F.concat(F.array(F.lit("")), urls.segments(path)), -1)
    return (shown == "next") | shown.contains("next page") | (urls.query_value(link, "page") != "") | base.contains("page")


def valid_bytes(status: Column, body: Column, most: int = BODY_BYTES) -> Column:
    """Bytes, up to `most`, of a JSON answer of status 2xx; 0 for others. A body of `most` bytes or more only has to begin like JSON."""
    size = F.octet_length(body)
    begins = F.regexp_replace(body, r"^\s+", "").rlike(r"^[{\[]")
    whole = F.when(size < most, F.try_parse_json(F.when(size < most, body)).isNotNull()).otherwise(True)
    return F.when(status.between(200, 299) & begins & whole, F.least(size, F.lit(most))).otherwise(0)


def with_results(endpoints: DataFrame, results: DataFrame) -> DataFrame:
    """Each endpoint with the first result (by ord) of its method and URL template; size and score 0 without one."""
    first = Window.partitionBy("method", "url_template").orderBy("ord")
    best = results.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("method", "url_template", "response_size", "score")
    joined = endpoints.join(best, ["method", "url_template"], "left")
    return joined.withColumns({"response_size": F.coalesce("response_size", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})


def param_value(args: Column, name: Column, default: Column) -> Column:
    """The supplied argument, trimmed; the parameter's default where it is blank or not there."""
    return F.coalesce(F.nullif(F.trim(F.try_element_at(args, name)), F.lit("")), default)


def parse_params(items: Column) -> Column:
    """key=value texts as values (a map, the last of a key counts) and invalid (those without a key or a sign)."""
    key, value = lambda x: F.trim(F.substring_index(x, "=", 1)), lambda x: F.trim(F.substr(x, F.instr(x, "=") + 1))
    good = lambda x: x.contains("=") & (key(x) != "")
    entries = F.transform(F.filter(items, good), lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda f: f["key"] == e["key"]))
    return F.struct(F.map_from_entries(last).alias("values"), F.filter(items, lambda x: ~good(x)).alias("invalid"))


def merge_schemas(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Schemas by domain: what exists stays, but for the session and origin of the incoming where it has them; the better coverage."""
    others = [c for c in existing.columns if c not in ("domain", "schema_type", "coverage", "session", "discovered_from")]
    joined = existing.alias("a").join(incoming.alias("b"), "domain", "full_outer")
    both = F.col("a.schema_type").isNotNull() & F.col("b.schema_type").isNotNull()
    filled = lambda c: F.nullif(c, F.lit(""))
    level = lambda x: F.col("a.coverage").eqNullSafe(x) | F.col("b.coverage").eqNullSafe(x)
    coverage = F.when(level(F.lit("complete")), "complete").when(level(F.lit("partial")), "partial").otherwise(F.coalesce(filled(F.col("b.coverage")), F.col("a.coverage")))
    return joined.select(
        "domain",
        F.when(both, "api").otherwise(F.coalesce("a.schema_type", "b.schema_type")).alias("schema_type"),
        coverage.alias("coverage"),
        F.coalesce("b.session", "a.session").alias("session"),
        F.coalesce(filled(F.col("b.discovered_from")), F.col("a.discovered_from")).alias("discovered_from"),
        *[F.when(F.col("a.schema_type").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in others],
    )
