"""What is put together from other parts: known sites and stores, catalogs, registry lists, outputs of pages and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons, urls
from ..functions import text as tx
from ..functions.dom import Node, parse_html
from .catalog import PROBE_CONFIDENCE, ordered_rules
from .extract import map_pages
from .schemas import is_store, overridden

#: Descriptions of known sites' endpoints, and of any other.
SITE_DESCRIPTIONS = {
    "github_repo": "GitHub repository metadata from the public GitHub REST API",
    "github_tree": "GitHub directory listing from the public GitHub Contents API",
    "github_blob": "GitHub file content from the public GitHub Contents API",
    "hn_item": "Hacker News item details from the public Firebase API",
    "x_tweet": "Public tweet metadata from the X syndication endpoint",
    "youtube_video": "Video metadata from the public YouTube oEmbed endpoint",
    "youtube_short": "Video metadata from the public YouTube oEmbed endpoint",
    "arkansas_court_case": "Arkansas court case details from the public judiciary API",
    "wikipedia_page": "Wikipedia page summary from the public REST API",
    "npm_package": "NPM package metadata from the public registry API",
    "npm_scoped_package": "NPM package metadata from the public registry API",
    "pypi_package": "PyPI package metadata from the public JSON API",
    "yahoo_finance_quote": "Yahoo Finance quote data from the public chart API",
    "hn_front_page": "Hacker News top stories from the public Firebase API",
}
SITE_DESCRIPTION = "Public endpoint discovered via a known-site adapter"
#: A store's endpoints (name, description, path, primary, confidence) and actions (name, method, path, params: name, type, required).
STORE_ENDPOINTS = [
    ("shopify_products", "Shopify store product catalog from the public AJAX API", "/products.json", True, 0.98),
    ("shopify_product", "Shopify single product detail from the public AJAX API", "/products/{handle}.json", False, 0.95),
]
STORE_ACTIONS = [
    ("add_to_cart", "POST", "/cart/add.js", [("id", "integer", True), ("quantity", "integer", True)]),
    ("get_cart", "GET", "/cart.js", []),
    ("update_cart", "POST", "/cart/update.js", [("updates", "object", True)]),
    ("change_cart_item", "POST", "/cart/change.js", [("id", "string", True), ("quantity", "integer", True)]),
]
#: Embedded patterns and what they hold.
PATTERN_DESCRIPTIONS = [
    ("__NEXT_DATA__", "Next.js SSR page props"),
    ("__UNIVERSAL_DATA_FOR_REHYDRATION__", "TikTok hydration data"),
    ("__FRONTITY_CONNECT_STATE__", "WordPress Frontity state"),
    ("SIGI_STATE", "TikTok legacy state"),
    ("__NUXT_DATA__", "Nuxt 3 payload"),
    ("__MODERN_ROUTER_DATA__", "TikTok modern router data"),
    ("ytInitialData", "YouTube page data (search results, video metadata, comments)"),
    ("ytInitialPlayerResponse", "YouTube player config (streams, captions, chapters)"),
    ("__INITIAL_STATE__", "Redux/generic initial state"),
    ("__APOLLO_STATE__", "Apollo GraphQL client cache"),
    ("__PRELOADED_STATE__", "Redux preloaded state"),
    ("__remixContext", "Remix framework route data"),
    ("__NUXT__", "Nuxt 2 SSR state"),
]
#: Elements that a snapshot leaves out, and its deepest level.
SNAPSHOT_SKIPS, SNAPSHOT_DEPTH = ("script", "style", "noscript", "svg", "iframe"), 5
#: Bytes of a response's preview and of each text in it.
PREVIEW_BYTES, PREVIEW_VALUE_BYTES = 2000, 80
#: Orders of a registry list.
REGISTRY_SORTS = {"trending": "popularity", "recently_verified": "verified_at", "recent": "created_at"}

#: A stored schema as a type, to read and write its JSON by.
SITE_SCHEMA = """id string, domain string, url_pattern string, schema_type string, coverage string, version int, created_at timestamp,
  discovered_from string, endpoints array<struct<name: string, description: string, method: string, url_template: string,
  headers: map<string, string>, variables: array<struct<name: string, source: string, pattern: string>>, is_primary: boolean, confidence: double>>"""

_GROUPS = r"(?<!\\)\((?:\?<([A-Za-z]\w*)>|(?!\?))"


def java_pattern(pattern: Column) -> Column:
    """A pattern with (?P<name> groups in the form that the JVM reads."""
    return F.regexp_replace(pattern, r"\(\?P<", "(?<")


def named_groups(text: Column, pattern: Column) -> Column:
    """What a fitting pattern's named groups hold; a map. Parentheses within character classes must be escaped."""
    names = F.regexp_extract_all(pattern, F.lit(_GROUPS), 1)
    found = F.transform(names, lambda n, i: F.struct(n.alias("key"), F.call_function("regexp_extract", text, pattern, i + 1).alias("value")))
    return F.map_from_entries(F.filter(found, lambda e: e["key"] != ""))


def query_values(url: Column) -> Column:
    """The first value, decoded, of each query key; a map."""
    decoded = lambda t: F.coalesce(F.try_url_decode(t), t)
    pairs = F.filter(F.split(urls.query(url), "&"), lambda p: p != "")
    entries = F.transform(
        pairs, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("value"))
    )
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda f: f["key"] == e["key"])))


def fill_template(template: Column, values: Column) -> Column:
    """The template with the value of each {name} that there is one for."""
    return F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def _positional(variables: Column, known: Column, segments: Column) -> Column:
    """Values of variables that are not known yet, by the number of their segment, or that one and all after it."""
    at = lambda v: v["pattern"].try_cast("int")
    fits = F.filter(
        variables,
        lambda v: v["source"].isin("path", "path_rest") & F.coalesce(at(v).between(0, F.size(segments) - 1), F.lit(False)) & ~F.array_contains(F.map_keys(known), v["name"]),
    )
    rest = lambda v: F.array_join(F.slice(segments, at(v) + 1, F.size(segments)), "/")
    made = F.transform(fits, lambda v: F.struct(v["name"].alias("key"), F.when(v["source"] == "path", F.get(segments, at(v))).otherwise(rest(v)).alias("value")))
    return F.map_from_entries(F.filter(made, lambda e, i: ~F.exists(F.slice(made, F.lit(1), i), lambda f: f["key"] == e["key"])))


def site_pattern(path: Column, variables: Column) -> Column:
    """The path's structure with {} for each segment that is one of the variables' (by number, or the last that its pattern fits)."""
    own, shape = urls.segments(path), urls.segments(urls.normalize_path(path))
    at = lambda v: F.coalesce(v["pattern"].try_cast("int"), (F.size(own) - F.array_position(F.reverse(F.transform(own, lambda s: F.regexp_like(s, v["pattern"]))), True)).cast("int"))
    one = lambda v, i: v["source"].isin("path", "url") & (at(v) == i)
    rest = lambda v, i: (v["source"] == "path_rest") & F.coalesce(v["pattern"].try_cast("int").between(0, i), F.lit(False))
    return F.concat(F.lit("/"), F.array_join(F.transform(shape, lambda s, i: F.when(F.exists(variables, lambda v: one(v, i) | rest(v, i)), F.lit("{}")).otherwise(s)), "/"))


def known_site_schemas(targets: DataFrame, sites: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """A schema row for each target (url) from the first site (by ord) that fits its host and path, and, with answers (the
    api_urls that gave JSON), whose API answered. sites has ord, name, host_pattern, path_pattern, api_url_template and variables
    (name, source, pattern) and at most MAX_RULES rows. A variable's value comes from the query, else the path, else
    the host, else the number of a segment; url_template keeps those that a later URL gives anew.
    """
    path = F.col("__p")
    rules = sites.withColumns({c: java_pattern(F.col(c)) for c in ("host_pattern", "path_pattern")}).withColumn("as_is", F.lit(True))
    if answers is not None:  # a template that a URL fills nothing into is one api_url for all URLs: its answer belongs to the rule
        asked_once = answers.join(F.broadcast(rules.select(F.col("api_url_template").alias("api_url")).distinct()), "api_url", "left_semi").distinct()
        given = F.broadcast(asked_once.withColumnRenamed("api_url", "__given"))
        rules = rules.join(given, F.col("api_url_template") == F.col("__given"), "left").withColumn("as_is", F.col("__given").isNotNull()).drop("__given")
    rules = F.broadcast(ordered_rules(rules))
    names = ["ord", "name", "host_pattern", "path_pattern", "api_url_template", "variables", "as_is"]

    def ruled(rows: DataFrame, number: Column) -> DataFrame:
        """rows (url, the number of a rule) with that rule and the values that it finds."""
        both = rows.crossJoin(rules).withColumn("__r", F.get("__rules", number)).drop("__rules")
        both = both.withColumns({"__h": urls.hostname(F.col("url")), "__p": urls.path(F.col("url"))}).select("*", *[F.col("__r")[c].alias(c) for c in names]).drop("__r")
        found = overridden(named_groups(F.col("__h"), F.col("host_pattern")), named_groups(path, F.col("path_pattern")))
        both = both.withColumn("__v", overridden(found, query_values(F.col("url"))))
        both = both.withColumn("__v", F.map_concat("__v", _positional(F.col("variables"), F.col("__v"), urls.segments(path))))
        return both.withColumn("api_url", fill_template(F.col("api_url_template"), F.col("__v")))

    own = targets.select("url").distinct().withColumns({"__h": urls.hostname(F.col("url")), "__p": urls.path(F.col("url"))}).crossJoin(rules)
    fits = F.transform("__rules", lambda r, i: F.when(F.regexp_like(F.col("__h"), r["host_pattern"]) & F.regexp_like(F.col("__p"), r["path_pattern"]), i))
    fits = F.filter(fits, lambda i: i.isNotNull())
    if answers is None:
        first = own.select("url", F.get(fits, 0).alias("__i")).filter("__i is not null")
    else:  # only URLs, rule numbers and api_urls move
        asked = ruled(own.select("url", F.explode(fits).alias("__i")), F.col("__i"))
        asked = asked.select("url", "__i", "api_url", (F.col("api_url") == F.col("api_url_template")).alias("__same"), "as_is")
        filled = asked.filter("not __same").select("url", "__i", "api_url").join(answers.select("api_url").distinct(), "api_url", "left_semi")
        first = asked.filter("__same and as_is").select("url", "__i").unionByName(filled.select("url", "__i")).groupBy("url").agg(F.min("__i").alias("__i"))
    first = ruled(first, F.col("__i"))
    kept = F.transform(F.filter("variables", lambda v: v["source"].isin("path", "path_rest", "query")), lambda v: v["name"])
    described = F.lit(SITE_DESCRIPTION)
    for name, text in SITE_DESCRIPTIONS.items():
        described = F.when(F.col("name") == name, text).otherwise(described)
    pattern = site_pattern(path, F.col("variables"))
    return first.select(
        "url", F.col("__h").alias("domain"), urls.schema_id(F.col("__h"), pattern).alias("id"), pattern.alias("url_pattern"), F.lit("api").alias("schema_type"),
        F.lit("partial").alias("coverage"), F.concat(F.lit("known_site:"), "name").alias("strategy"), "name", described.alias("description"), F.lit("GET").alias("method"),
        fill_template(F.col("api_url_template"), F.map_filter("__v", lambda k, _: ~F.array_contains(kept, k))).alias("url_template"),
        "api_url", F.lit(PROBE_CONFIDENCE["known_site"]).alias("confidence"),
    )


def origin(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://", 0), urls.authority(url))


def store_schemas(targets: DataFrame, responses: DataFrame) -> DataFrame:
    """Two endpoint rows for each target (url) whose origin's /products.json (responses: url, body) lists products as stores do."""
    stores = responses.filter(is_store(F.col("body"))).select(F.col("url").alias("probe_url")).distinct()
    asked = targets.select("url", F.concat(origin(F.col("url")), F.lit("/products.json")).alias("probe_url")).distinct()
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(p).alias("path"), F.lit(first).alias("is_primary"), F.lit(c).alias("confidence"))
        for n, d, p, first, c in STORE_ENDPOINTS
    ])
    domain = urls.hostname(F.col("url"))
    return asked.join(stores, "probe_url", "left_semi").withColumn("e", F.explode(rows)).select(
        "url", domain.alias("domain"), urls.schema_id(domain, F.lit("/products")).alias("id"), F.lit("/products").alias("url_pattern"), F.lit("api").alias("schema_type"),
        F.lit("complete").alias("coverage"), F.lit("shopify").alias("strategy"), "e.name", "e.description", F.lit("GET").alias("method"),
        F.concat(origin(F.col("url")), "e.path").alias("url_template"), "e.is_primary", "e.confidence",
    )


def store_actions(stores: DataFrame) -> DataFrame:
    """The cart actions that a store (url) declares beside its endpoints."""
    kind = "array<struct<name:string,type:string,required:boolean>>"
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("name"), F.lit(m).alias("method"), F.lit(path).alias("path"),
            F.array(*[F.struct(F.lit(k).alias("name"), F.lit(t).alias("type"), F.lit(r).alias("required")) for k, t, r in params]).cast(kind).alias("params"),
        )
        for n, m, path, params in STORE_ACTIONS
    ])
    return stores.withColumn("a", F.explode(rows)).select(
        "url", "a.name", F.lit("api_call").alias("kind"), F.lit("api_call").alias("transport"), "a.method", F.concat(origin(F.col("url")), "a.path").alias("url_template"),
        F.lit("shopify_ajax_api").alias("source"), F.lit(0.98).alias("confidence"), "a.params",
    )


def assemble_catalogs(targets: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per target (url, api_coverage: null without an API schema, empty if that has none) with its deduplicated actions.

    hybrid: an API schema, and more actions than it gave (source api_schema); api: no more than those; else html_extraction.
    """
    shown = F.array_sort(F.collect_list(F.struct("name", "kind", "transport", "url_template", "source", "confidence")))
    grouped = actions.groupBy("url").agg(shown.alias("actions"), F.count_if(F.col("source") == "api_schema").alias("__api"))
    joined = targets.join(grouped, "url", "left").withColumn("actions", F.coalesce("actions", F.array()))
    more = F.size("actions") > F.coalesce("__api", F.lit(0))
    return joined.select(
        urls.authority(F.col("url")).alias("domain"), "url",
        F.when(F.col("api_coverage").isNotNull() & more, "hybrid").when(F.col("api_coverage").isNotNull(), "api").otherwise("html_extraction").alias("source"),
        F.coalesce(F.nullif("api_coverage", F.lit("")), F.lit("partial")).alias("coverage"), "actions",
    )


def registry_list(registry: DataFrame, category: str = "", query: str = "", sort: str = "", hash_bytes: int = 12) -> DataFrame:
    """Registered schemas (site, intent_category, version_hash) of a category whose site holds a text, in the order asked for."""
    rows = registry
    if category:
        rows = rows.filter(F.col("intent_category") == category)
    if query:
        rows = rows.filter(F.lower("site").contains(query.lower()))
    if sort:
        rows = rows.orderBy(F.desc(REGISTRY_SORTS[sort]), "site")
    long = F.octet_length("version_hash") > hash_bytes
    return rows.select("site", "intent_category", F.when(long, F.concat(tx.cut_bytes(F.col("version_hash"), hash_bytes), F.lit("…"))).otherwise(F.col("version_hash")).alias("version"))


def dashboard_url(api_url: Column) -> Column:
    """The dashboard that belongs to an API's base URL."""
    return F.when(api_url.startswith("https://api."), F.concat(F.lit("https://"), F.substr(api_url, F.lit(13)), F.lit("/dashboard"))).otherwise(
        F.concat(F.regexp_replace(api_url, "/+$", ""), F.lit("/dashboard"))
    )


def patterns_map(embedded: Column, next_data: Column) -> Column:
    """Embedded scripts and server state under one map of JSON texts; null where there is neither."""
    own = F.coalesce(embedded, F.create_map().cast("map<string,string>"))
    both = F.when(next_data.isNotNull(), overridden(own, F.create_map(F.lit("__NEXT_DATA__"), next_data))).otherwise(own)
    return F.when(F.size(both) > 0, both)


def probe_outputs(probes: DataFrame, candidates: DataFrame) -> DataFrame:
    """One JSON text per probed url: strategy, html_size_bytes, stealth_required, and candidates (strategy, score, schema_id,
    endpoint_count, url_template) from the best on; what is empty is left out."""
    entry = F.struct((-F.col("score")).alias("__o"), "strategy", "score", "schema_id", "endpoint_count", "url_template")
    grouped = candidates.groupBy("url").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    shown = F.transform("c", lambda x: x.dropFields("__o"))
    size = F.octet_length("html")
    return probes.join(grouped, "url", "left").select("url", F.to_json(F.struct(
        "url", F.nullif("strategy", F.lit("")).alias("strategy"), F.when(F.col("requires_stealth"), True).alias("stealth_required"),
        F.when(size > 0, True).alias("has_html"), F.when(size > 0, size).alias("html_size_bytes"), shown.alias("candidates"),
    )).alias("json"))


def pattern_catalogue(spark) -> DataFrame:
    """The known embedded patterns, each once, with a description."""
    return spark.createDataFrame(PATTERN_DESCRIPTIONS, "name string, description string")


def pattern_counts(pages: DataFrame) -> DataFrame:
    """The catalogue of embedded patterns, with the number of pages whose html holds each name."""
    names = F.array(*[F.lit(n) for n, _ in PATTERN_DESCRIPTIONS])
    held = pages.select(F.explode(F.filter(names, lambda n: F.col("html").contains(n))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_pages"))
    return pattern_catalogue(pages.sparkSession).join(held, "name", "left").fillna(0, ["n_pages"])


def schema_to_json(schema: Column) -> Column:
    return F.to_json(schema)


def schema_from_json(text: Column) -> Column:
    """A stored schema from its JSON; null if that is not an object."""
    return F.from_json(F.when(F.get_json_object(text, "$").startswith("{"), text), SITE_SCHEMA)


def preview(body: Column) -> Column:
    """A response's start: JSON with its long texts and lists cut and indented, else the text itself; marked where cut."""
    import json

    def one(text: str) -> str:
        ok, value = jsons._load(text)
        shown = json.dumps(jsons.truncate(value, PREVIEW_VALUE_BYTES), indent=2, ensure_ascii=False, sort_keys=True) if ok else text
        data = shown.encode("utf-8", "replace")
        return shown if len(data) <= PREVIEW_BYTES else data[:PREVIEW_BYTES].decode("utf-8", "ignore") + ("\n... (truncated)" if ok else "...")

    return jsons._text_udf(one, "string")(body)


def _snapshot(node: Node, depth: int = 0) -> str:
    if depth > SNAPSHOT_DEPTH or node.tag in SNAPSHOT_SKIPS:
        return ""
    parts = (_snapshot(c, depth + 1) if c.tag else c.text.strip() + " " if c.text.strip() else "" for c in node.children)
    text = "".join(parts).strip()
    return f"<{node.tag}>{text}</{node.tag}>\n" if text else ""


def dom_snapshots(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with a short form of the body's tree, a few levels deep, in place of the html."""

    def one(text: str, _: str) -> dict:
        body = parse_html(text).find(lambda n: n.tag == "body")
        return {"snapshot": _snapshot(body) if body else ""}

    return map_pages(pages, one, ("snapshot",), {"snapshot": "string"}, html, url)
