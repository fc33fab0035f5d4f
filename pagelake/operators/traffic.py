"""Captured traffic: HAR filtering and totals, request-response joins, auth walls, block pages, vendor markers, best responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls

#: Parts of URLs that only track.
TRACKING = [
    "analytics", "tracking", "/log/", "/logging", "beacon", "pixel", "healthz", "metrics", "telemetry", "sentry", "datadog", "segment", "gtag",
    "fbevents", "hotjar", "mixpanel", "amplitude", "sensorcollect", "protechts.net", "/realtime/", "presencestatus",
]
#: Login parts of URLs and of pages.
LOGIN_URLS = ["/login", "/signin", "/sign-in", "/sign_in", "/auth", "/sso", "/authorize", "/oauth"]
LOGIN_TEXTS = ['type="password"', "sign in", "sign up", "log in", "log on"]
#: Phrases of block pages, with an error status and with status 200.
BLOCK_STATUSES = (403, 429, 503)
BLOCK_PHRASES = [
    "checking your browser", "before you access", "robot or human", "press & hold", "are you a human", "just a moment", "cf-browser-verification",
    "cf_chl_opt", "enable javascript and cookies to continue", "datadome", "geo.captcha-delivery.com", "captcha-delivery",
    "please verify you are a human", "access to this page has been denied",
]
SURE_PHRASES = [
    "checking your browser before you access", "robot or human", "just a moment...", "cf-browser-verification", "cf_chl_opt",
    "geo.captcha-delivery.com", "please verify you are a human",
]
#: Vendor, where its marker stands, the marker.
MARKERS = [
    ("Cloudflare", "body", "cf_chl_opt"), ("Cloudflare", "body", "cf-browser-verification"), ("Cloudflare", "body", "challenges.cloudflare.com"),
    ("DataDome", "body", "datadome"), ("DataDome", "body", "geo.captcha-delivery.com"), ("PerimeterX", "body", "perimeterx"),
    ("PerimeterX", "header", "_pxhd"), ("Akamai", "body", "akamai"), ("Akamai", "header", "_abck"), ("AWS WAF", "body", "awswaf"),
    ("AWS WAF", "body", "aws-waf-token"), ("Imperva", "body", "incapsula"), ("Imperva", "header", "incap_ses"), ("hCaptcha", "body", "hcaptcha.com"),
    ("reCAPTCHA", "body", "recaptcha"), ("TikTok Signing", "body", "webmssdk"), ("TikTok Signing", "body", "byted_acrawler"),
]
#: Request headers that say nothing about an API.
BROWSER_HEADERS = [
    "accept-encoding", "accept-language", "cache-control", "connection", "sec-ch-ua", "sec-ch-ua-mobile", "sec-ch-ua-platform", "sec-fetch-dest",
    "sec-fetch-mode", "sec-fetch-site", "upgrade-insecure-requests", "user-agent", "referer", "origin", "dnt", "pragma", "if-none-match",
    "if-modified-since",
]
TRANSIENT = (429, 502, 503, 504)


def is_api(content_type: Column) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return low.contains("json") | low.contains("graphql")


def is_tracking(url: Column) -> Column:
    return tx.contains_any(F.lower(url), TRACKING)


def filter_har(entries: DataFrame) -> DataFrame:
    """API traffic without tracking, the first entry of each capture's method and URL; in a column order by capture and ord."""
    kept = entries.filter(is_api(F.col("content_type")) & ~is_tracking(F.col("url")))
    first = Window.partitionBy("capture_id", "method", "url").orderBy("ord")
    return kept.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def summarize_har(entries: DataFrame) -> DataFrame:
    """Requests, API requests and body bytes of each capture."""
    size = F.octet_length(F.coalesce(F.col("body"), F.lit("")))
    return entries.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(is_api(F.col("content_type"))).alias("n_api"), F.sum(size).cast("bigint").alias("body_bytes")
    )


def join_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its response by request_id; a missing one is empty."""
    return requests.join(responses, "request_id", "left")


def needs_auth(status: Column, final_url: Column, dom: Column) -> Column:
    return status.isin(401, 403) | tx.contains_any(F.lower(final_url), LOGIN_URLS) | tx.contains_any(F.lower(dom), LOGIN_TEXTS)


def is_blocked(status: Column, body: Column) -> Column:
    low = F.lower(body)
    return F.when(status.isin(*BLOCK_STATUSES), tx.contains_any(low, BLOCK_PHRASES)).when(status == 200, tx.contains_any(low, SURE_PHRASES)).otherwise(False)


def failure_kind(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status.isin(*TRANSIENT), "transient").otherwise("broken")


def marker_hits(body: Column, cookies: Column) -> Column:
    """Sorted distinct (name, location, marker) of the vendor markers that a response shows."""
    hits = [
        F.when(F.lower(body if place == "body" else cookies).contains(marker), F.struct(F.lit(name).alias("name"), F.lit(place).alias("location"), F.lit(marker).alias("marker")))
        for name, place, marker in MARKERS
    ]
    return F.array_sort(F.filter(F.array(*hits), lambda h: h.isNotNull()))


def relevant_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*BROWSER_HEADERS))


def response_score(url: Column, body: Column, target_path: Column) -> Column:
    """Body bytes, plus weight for the target's segments and API paths, less for settings and messages."""
    low = F.lower(url)
    parts = F.filter(F.split(F.lower(target_path), "/"), lambda s: F.length(s) > 2)
    named = F.size(F.filter(parts, lambda s: low.contains(s)))
    api = F.when(low.contains("graphql") | low.contains("/api/"), 10_000).otherwise(0)
    side = F.when(tx.contains_any(low, ["setting", "messaging", "notification", "policy"]), 30_000).otherwise(0)
    return F.octet_length(body) + 50_000 * named + api - side


def best_response(entries: DataFrame, target_path: Column) -> DataFrame:
    """Each capture's entry of the highest positive score; the first on a tie."""
    scored = entries.withColumn("score", response_score(F.col("url"), F.coalesce("body", F.lit("")), target_path).cast("bigint")).filter("score > 0")
    first = Window.partitionBy("capture_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def merge_included(responses: DataFrame) -> DataFrame:
    """Per capture, the distinct objects of all bodies' included lists: the first of each entityUrn, all without one."""
    items = responses.select("capture_id", "ord", F.posexplode(F.from_json(F.get_json_object("body", "$.included"), "array<string>")).alias("pos", "item"))
    items = items.withColumn("urn", F.get_json_object("item", "$.entityUrn"))
    first = Window.partitionBy("capture_id", "urn").orderBy("ord", "pos")
    kept = items.withColumn("__n", F.when(F.col("urn").isNull(), 1).otherwise(F.row_number().over(first))).filter("__n = 1")
    return kept.select("capture_id", "ord", "pos", "urn", "item")


def merge_by_endpoint(responses: DataFrame) -> DataFrame:
    """One JSON object of all endpoints' bodies per capture in the order of their names, the last of a name; null if any endpoint failed or none has a
    name. A response without a name is no member, but may fail."""
    last = responses.groupBy("capture_id", "name").agg(F.max_by("body", "ord").alias("body"), F.bool_and(F.col("status").between(200, 299)).alias("ok"))
    pair = F.concat(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(":"), "body")
    member = F.when(F.col("name").isNotNull() & F.col("body").isNotNull(), F.struct("name", pair.alias("pair")))
    pairs = last.groupBy("capture_id").agg(F.array_sort(F.collect_list(member))["pair"].alias("pairs"), F.bool_and("ok").alias("ok"))
    return pairs.select("capture_id", F.when(F.col("ok") & (F.size("pairs") > 0), F.concat(F.lit("{"), F.array_join("pairs", ","), F.lit("}"))).alias("data"))


def script_hosts(html: Column) -> Column:
    """Sorted distinct hosts of absolute src URLs."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)src=["'](?:https?:)?//([^/"'?#:]+)"""), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def preconnect_hosts(html: Column) -> Column:
    """Sorted distinct hosts of preconnect and dns-prefetch links."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), 0), lambda x: x.rlike(r"""(?i)rel=["']?(preconnect|dns-prefetch)"""))
    hosts = F.transform(links, lambda x: F.lower(F.regexp_extract(x, r"""(?i)href=["']?(?:https?:)?//([^/"'?#:\s>]+)""", 1)))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != "")))


def meta_generator(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?i)<meta\s+name=["']generator["']\s+content=["']([^"']*)["']""", 1), F.lit(""))


def as_requests(entries: DataFrame) -> DataFrame:
    """Replay specifications: url, method (GET without one) and body; rows without a URL go."""
    return entries.filter(F.coalesce("url", F.lit("")) != "").select("url", F.coalesce(F.nullif("method", F.lit("")), F.lit("GET")).alias("method"), "body")


def replay_body(body: Column, size: int = 2000) -> Column:
    """A body as JSON if it is, else its first bytes and whether they are all."""
    is_json = F.try_parse_json(body).isNotNull()
    return F.struct(
        F.when(is_json, body).alias("json"), F.when(~is_json, tx.cut_bytes(body, size)).alias("text"), (~is_json & (F.octet_length(body) > size)).alias("body_truncated")
    )


def host_is_spa(urls_df: DataFrame, domains: DataFrame) -> DataFrame:
    """Rows whose bare host is among the learnt domains."""
    return urls_df.withColumn("domain", urls.bare_host(F.col("url"))).join(domains, "domain", "left_semi")
