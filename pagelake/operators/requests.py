"""The requests that endpoints make for targets, and what their captured responses are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import row_templates as rt
from ..functions.text import cut_bytes
from .traffic import failure_kind

MAX_BODY = 10 << 20
AGENT = "pagelake"


def merged_headers(*layers: Column) -> Column:
    """Headers of all layers, later ones over earlier ones; names are compared without case, and written as HTTP writes them."""
    canonical = lambda k: F.array_join(F.transform(F.split(k, "-", -1), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "-")
    empty = F.create_map().cast("map<string,string>")
    out = empty
    for layer in layers:
        pairs = F.transform(F.map_entries(F.coalesce(layer, empty)), lambda e: F.struct(canonical(e["key"]).alias("key"), e["value"].alias("value")))
        last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda x: x["key"] == e["key"]))
        new = F.map_from_entries(last)
        out = F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(new, k)), new)
    return out


def endpoint_requests(targets: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A request for each target (domain, url, overrides) and endpoint of its domain.

    endpoints: domain, name, method, url_template, variables (name, source, pattern), headers, body_template and content_type (null: no body).
    request_url, and with it the request, is null where a variable of the endpoint has no value for the target.
    """
    known = endpoints.withColumn("variables", rt.checked(F.coalesce("variables", F.array().cast(rt.VARIABLES))))
    both = targets.join(known, "domain")
    own = F.create_map(F.lit("User-Agent"), F.lit(AGENT))
    typed = F.when(F.coalesce("content_type", F.lit("")) != "", F.create_map(F.lit("Content-Type"), F.col("content_type")))
    url, body = rt.fill(F.col("url_template"), F.col("variables"), F.col("url")), rt.fill(F.col("body_template"), F.col("variables"), F.col("url"))
    failed = url.isNull() | (body.isNull() & F.col("body_template").isNotNull())
    return both.select(
        "domain", "url", "name", F.upper(F.coalesce(F.nullif("method", F.lit("")), F.lit("GET"))).alias("method"), F.when(~failed, url).alias("request_url"), F.when(~failed, body).alias("body"),
        merged_headers(own, typed, F.col("headers"), F.col("overrides")).alias("headers"),
    )


def scan_endpoints(targets: DataFrame, endpoints: DataFrame, responses: DataFrame) -> DataFrame:
    """endpoint_requests with the captured response (method, url, request_body; status, body) to each: outcome is unresolved, missing, ok,
    transient or broken, and data the body of an ok one, cut at MAX_BODY bytes. Of several responses to a request the last (by ord) counts."""
    asked = endpoint_requests(targets, endpoints)
    keys = {"method": F.upper("method"), "request_url": F.col("url"), "body": F.coalesce("request_body", F.lit(""))}
    last = responses.groupBy(*[v.alias(f"r_{k}") for k, v in keys.items()]).agg(F.max_by(F.struct("status", "body"), "ord").alias("r"))
    same = (F.col("method") == F.col("r_method")) & (F.col("request_url") == F.col("r_request_url")) & (F.coalesce("body", F.lit("")) == F.col("r_body"))
    found = asked.join(last, same, "left")
    outcome = F.when(F.col("request_url").isNull(), "unresolved").when(F.col("r").isNull(), "missing").otherwise(failure_kind(F.col("r.status")))
    return found.select(*asked.columns, outcome.alias("outcome"), F.col("r.status").alias("status"), F.when(outcome == "ok", cut_bytes(F.col("r.body"), MAX_BODY)).alias("data"))
