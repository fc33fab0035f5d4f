"""Schemas and their catalog: pattern matching, lookup priority, merge, probe candidates, endpoint ranks, and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import row_templates
from ..functions import text as tx
from ..functions import urls

#: What a probe strategy is worth, and the confidence of its endpoint.
PROBE_SCORES = {"known_site": 140, "shopify": 130, "json_suffix": 120, "accept_header": 80, "wp_json": 20}
PROBE_CONFIDENCE = {"known_site": 0.98, "shopify": 0.98, "json_suffix": 0.96, "accept_header": 0.8, "wp_json": 0.3}
#: Query keys that search and that page.
SEARCH_KEYS = ["q", "query", "search", "keyword", "keywords", "k", "term", "nkw"]
PAGE_KEYS = ["page", "pagenum", "pageno", "pagenumber", "pgn", "pg"]
#: What adds to and takes from an action's rank.
RANK_TRANSPORT = {"api_call": 40, "http_get": 15}
RANK_KIND = {"search": 30, "paginate": 20, "navigate": 5}
RANK_SOURCE = {"api_schema": 20, "url_pattern": 15}
NOISY_TOKENS = ["qid=", "ref=", "_trksid=", "anti-csrftoken", "offerListingId", "clientName"]
QUERY_PARAMS = ["query", "q", "search", "keyword", "keywords", "term", "nkw"]
COVERAGE = {"complete": 2, "partial": 1}
#: Paths that sites commonly answer, and what answers there.
WELL_KNOWN = [
    ("/robots.txt", "robots"), ("/sitemap.xml", "sitemap"), ("/feed", "rss"), ("/feeds", "rss"), ("/rss", "rss"), ("/atom.xml", "rss"),
    ("/feed.xml", "rss"), ("/.well-known/openid-configuration", "oidc"), ("/graphql", "graphql"), ("/api/graphql", "graphql"), ("/oembed", "oembed"),
    ("/wp-json/wp/v2/posts?per_page=1", "wordpress"), ("/api", "api"), ("/api/v1", "api"), ("/.json", "json"),
]
SEMANTIC_LEAST = 0.55
#: Rules of known sites that are sent to every task, at most.
MAX_RULES = 10_000


def _looked_up(table: dict[str, int], key: Column) -> Column:
    out = F.lit(0)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def _masked(segments: Column, mask: Column) -> Column:
    """Segments as a path with {} where the mask has 1."""
    return F.array_join(F.zip_with(segments, F.split(mask, ""), lambda s, m: F.when(m == "1", "{}").otherwise(s)), "/")


def pattern_hits(targets: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each target (url) with every fitting pattern of its domain.

    Patterns are indexed by where their wildcards stand (their mask): a target is masked in each way that its domain's patterns of as many
    segments are, and looked up by equality. Rows grow with the masks of a domain and with what fits, not with its patterns.
    """
    own = targets.withColumn("domain", urls.authority(F.col("url"))).withColumn("__u", urls.segments(urls.normalize_path(urls.path(F.col("url")))))
    own = own.withColumn("__k", F.size("__u"))
    stored = schemas.withColumn("__p", urls.segments(F.col("url_pattern"))).withColumn("specificity", urls.specificity(F.col("url_pattern")))
    stored = stored.withColumn("__mask", F.array_join(F.transform("__p", lambda s: F.when(s == "{}", "1").otherwise("0")), "")).withColumn("__key", _masked(F.col("__p"), F.col("__mask")))
    masks = stored.select("domain", F.size("__p").alias("__k"), "__mask").distinct()
    asked = own.join(masks, ["domain", "__k"]).withColumn("__key", _masked(F.col("__u"), F.col("__mask")))
    return asked.join(stored.drop("__p"), ["domain", "__mask", "__key"]).drop("__u", "__k", "__mask", "__key")


def match_patterns(targets: DataFrame, schemas: DataFrame, key: str = "url") -> DataFrame:
    """Each target (url) with its domain's most specific fitting pattern, the first (by ord) on a tie. Where targets share a url, the one with the
    least page_id stands for it, if there is that column."""
    least = [c for c in ("page_id",) if c in targets.columns]
    return _first(pattern_hits(targets, schemas), [key], F.desc("specificity"), "ord", *least)


def schema_class(schema_type: Column, n_endpoints: Column, rules: Column) -> Column:
    """api, css, next_data or other. A schema without a type is judged by what it has: rules make it css (next_data if their strategy is), endpoints
    without rules api. For lookups css and next_data are css, all else is api."""
    kind = F.coalesce(schema_type, F.lit(""))
    css = (kind == "css") | ((kind == "") & rules.isNotNull())
    return F.when(css & (F.get_json_object(rules, "$.strategy") == "next_data"), "next_data").when(css, "css").when((kind == "api") | ((kind == "") & (n_endpoints > 0)), "api").otherwise("other")


def lookup(targets: DataFrame, schemas: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Each target's best live API schema, else its best live CSS schema; targets without either are left out."""
    live = schemas.filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl_seconds)
    kinds = live.withColumn("bucket", F.when(F.col("schema_type") == "css", "css").otherwise("api"))
    found = [match_patterns(targets, kinds.filter(F.col("bucket") == b)) for b in ("api", "css")]
    return _first(found[0].unionByName(found[1]), ["url"], "bucket")


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest version (by version, then incoming) of each domain and id."""
    both = stored.withColumn("__s", F.lit(0)).unionByName(incoming.withColumn("__s", F.lit(1)))
    return _first(both, ["domain", "id"], F.desc("version"), F.desc("__s")).drop("__s")


#: What merge_endpoints fills from the first endpoint that has it, and from the first where it is not empty.
FIRST_KNOWN, FIRST_FILLED = ("body", "response_schema"), ("query_params", "variables", "response_mapping")


def merge_endpoints(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Endpoints of both schemas, one for each domain, method (of any case), URL template and body template, in the order of
    their first one, the existing before the incoming; with one primary a domain, the first of the greatest confidence.

    The first name that is neither empty nor a placeholder counts, else the last one. The first description counts; one that
    only repeats the name, the next one replaces. The last method that is not empty counts, of headers the last value, and
    the greatest confidence. Columns beside domain, method, url_template, name, description, confidence and ord are merged
    where both have them: body_template (part of the key), headers, body, query_params, variables, response_schema,
    response_mapping. Repeats of one endpoint are aggregated before they move.
    """
    side = lambda df, s: df.select(*columns, F.struct(F.lit(s).alias("side"), "ord").alias("pos"))
    optional = [c for c in ("body_template", "headers", *FIRST_KNOWN, *FIRST_FILLED) if c in existing.columns and c in incoming.columns]
    columns = ["domain", "method", "url_template", "name", "description", "confidence", *optional]
    rows = side(existing, 0).unionByName(side(incoming, 1)).withColumn("method_key", F.upper(F.coalesce("method", F.lit(""))))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("method", "name", "description", *(["body_template"] if "body_template" in optional else []))})
    keys = ["domain", "method_key", "url_template", *(["body_template"] if "body_template" in optional else [])]
    good, described = ~F.col("name").isin("", "directJSON"), F.col("description") != ""
    first = lambda value, where: F.min_by(F.when(where, value), F.when(where, F.col("pos")))
    kept = [first(F.col(c), F.col(c).isNotNull()).alias(c) for c in FIRST_KNOWN if c in optional]
    kept += [first(F.col(c), F.size(c) > 0).alias(c) for c in FIRST_FILLED if c in optional]
    merged = rows.groupBy(*keys).agg(
        F.coalesce(first(F.col("name"), good), F.max_by("name", "pos")).alias("name"),
        F.min(F.when(good, F.col("pos"))).alias("named_at"),
        F.coalesce(first(F.col("description"), described), F.lit("")).alias("description"),
        F.min(F.when(described, F.col("pos"))).alias("described_at"),
        F.coalesce(F.max_by(F.when(F.col("method") != "", F.col("method")), F.when(F.col("method") != "", F.col("pos"))), F.lit("")).alias("method"),
        F.max("confidence").alias("confidence"),
        F.min("pos").alias("pos"),
        *kept,
    )
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    repeats = merged.filter("description = name and description <> ''").select(*keys, "name", F.greatest("named_at", "described_at").alias("since"), "described_at")
    later = rows.alias("r").join(repeats.alias("m"), same("r", "m")).filter("r.pos >= m.since and r.pos > m.described_at and r.description <> '' and r.description <> m.name")
    better = later.groupBy(*[F.col(f"m.{k}").alias(k) for k in keys]).agg(F.min_by("r.description", "r.pos").alias("better"))
    joined = merged.alias("e").join(better.alias("b"), same("e", "b"), "left").select("e.*", F.coalesce("b.better", "e.description").alias("__description"))
    joined = joined.drop("description").withColumnRenamed("__description", "description")
    if "headers" in optional:
        one = rows.select(*keys, "pos", F.explode("headers").alias("header", "value")).groupBy(*keys, "header").agg(F.max_by("value", "pos").alias("value"))
        heads = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("header", "value"))).alias("headers"))
        joined = joined.alias("e").join(heads.alias("h"), same("e", "h"), "left").select("e.*", F.coalesce("h.headers", F.create_map().cast("map<string,string>")).alias("headers"))
    rank = Window.partitionBy("domain").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "pos")
    return joined.withColumn("is_primary", F.row_number().over(rank) == 1).withColumn("ord", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).select(*columns, "is_primary", "ord")


def merged_coverage(coverage: Column) -> Column:
    """The better coverage of a group."""
    return F.max_by(coverage, _looked_up(COVERAGE, coverage))


def bounded_rules(rules: DataFrame) -> DataFrame:
    """The rules, if they are few enough to be broadcast; else an error, as patterns have no key to join on."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return rules


def ordered_rules(rules: DataFrame) -> DataFrame:
    """The rules (at most MAX_RULES) as one row, an array of structs in the order of ord: to be broadcast to rows, not joined with them."""
    entry = F.struct(F.col("ord").alias("__ord"), F.struct(*rules.columns).alias("rule"))
    return bounded_rules(rules).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["rule"]).alias("__rules"))


def known_site(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """Each target with the first (by ord) site whose host and path patterns fit, also where targets share a url; there are at most MAX_RULES sites."""
    own = targets.withColumn("__h", urls.hostname(F.col("url"))).withColumn("__p", urls.path(F.col("url")))
    both = own.crossJoin(F.broadcast(ordered_rules(sites)))
    fits = F.filter("__rules", lambda r: F.rlike(F.col("__h"), r["host_pattern"]) & F.rlike(F.col("__p"), r["path_pattern"]))
    return both.withColumn("__r", F.get(fits, 0)).filter("__r is not null").select(*targets.columns, *[F.col("__r")[c].alias(c) for c in sites.columns])


def probe_candidates(targets: DataFrame) -> DataFrame:
    """The URLs to ask for each target: with .json, as it is by Accept, and WordPress's post list. Without a host they are relative."""
    url = F.regexp_replace(F.col("url"), rf"[?#]{urls.REST}", "")
    base = F.concat(F.regexp_extract("url", "^[A-Za-z]+://", 0), F.coalesce(urls.authority(F.col("url")), F.lit("")))
    slug = F.element_at(F.concat(F.array(F.lit("")), urls.segments(urls.path(F.col("url")))), -1)
    asks = [
        ("json_suffix", F.concat(F.regexp_replace(url, r"/+\z", ""), F.lit(".json"))),
        ("accept_header", F.col("url")),
        ("wp_json", F.concat(base, F.lit("/wp-json/wp/v2/posts?slug="), slug)),
    ]
    return targets.withColumn("probe", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), u.alias("probe_url")) for s, u in asks]))).select("*", "probe.*").drop("probe")


def all_probe_candidates(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """What all five strategies ask for each target: strategy, probe_url, pattern and has_headers, for rank_candidates.

    sites: the rules of known_site with api_template and variables (name, source, pattern); a rule one of whose variables has no value asks nothing.
    Every target's site is asked as a store, too.
    """
    own = urls.normalize_path(urls.path(F.col("url")))
    plain = probe_candidates(targets).withColumns({"pattern": own, "has_headers": F.col("strategy") == "accept_header"})
    checked = bounded_rules(sites).withColumn("variables", row_templates.checked(F.col("variables")))
    known = known_site(targets, checked).withColumn("probe_url", row_templates.fill(F.col("api_template"), F.col("variables"), F.col("url")))
    made = lambda df, name, pattern: df.select(*targets.columns, F.lit(name).alias("strategy"), "probe_url", pattern.alias("pattern"), F.lit(False).alias("has_headers"))
    known = made(known.filter("probe_url is not null"), "known_site", own)
    store = targets.withColumn("probe_url", F.concat(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://", 0), F.coalesce(urls.authority(F.col("url")), F.lit("")), F.lit("/products.json")))
    return plain.unionByName(known).unionByName(made(store, "shopify", F.lit("/products")))


def probe_score(strategy: Column, pattern: Column, has_headers: Column) -> Column:
    return _looked_up(PROBE_SCORES, strategy) + F.when(pattern.contains("{}"), 10).otherwise(0) - F.when(has_headers, 5).otherwise(0)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Each target's candidates without repeats of method and template, the best first (score, then strategy). Where rows share a url, the one with
    the least page_id stands for it, if there is that column."""
    least = [c for c in ("page_id",) if c in candidates.columns]
    first = _first(candidates, ["url", "method", "url_template"], F.desc("score"), "strategy", *least)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "strategy", *least)))


def rank_endpoints(endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Endpoints that fit semantically, by score, then size, then order, equal ones by template; the first is primary."""
    kept = endpoints.filter(F.col("semantic_score") >= SEMANTIC_LEAST)
    rank = Window.partitionBy(*keys).orderBy(F.desc("semantic_score"), F.desc("response_size"), F.asc_nulls_last("ord"), "url_template")
    return kept.withColumn("rank", F.row_number().over(rank)).withColumn("is_primary", F.col("rank") == 1)


def is_search_key(key: Column) -> Column:
    """Whether a query key searches: it equals or holds one of the known ones, as it stands or without other signs."""
    plain = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    return tx.contains_any(F.lower(key), SEARCH_KEYS) | tx.contains_any(plain, SEARCH_KEYS)


def is_page_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "").isin(*PAGE_KEYS)


def action_rank(a) -> Column:
    """An action's rank from its columns kind, transport, source, confidence, url_template and params (name, required)."""
    name = lambda p: F.regexp_replace(F.lower(p["name"]), "[^a-z0-9]", "")
    by_param = F.aggregate(
        a["params"],
        F.lit(0),
        lambda acc, p: acc
        - 4
        + F.when(name(p).isin(*QUERY_PARAMS), 18).when(name(p).isin("url", "ref", "qid"), -8).otherwise(0)
        - F.when(p["required"], 0).otherwise(2),
    )
    template = a["url_template"]
    noisy = sum((F.when(template.contains(t), 12).otherwise(0) for t in NOISY_TOKENS), F.lit(0))
    slot = F.when(template.contains("{query}") | template.contains("{q}"), 20).otherwise(0)
    single = F.when((a["kind"] == "search") & (F.size(a["params"]) == 1), 10).otherwise(0)
    base = F.floor(a["confidence"] * 100).cast("int") + _looked_up(RANK_TRANSPORT, a["transport"]) + _looked_up(RANK_KIND, a["kind"]) + _looked_up(RANK_SOURCE, a["source"])
    return base + by_param - F.when(F.octet_length(template) > 120, 8).otherwise(0) - noisy + slot + single


def dedupe_actions(actions: DataFrame, keys: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """The best of each name, transport and template; further actions of a name become name_2, name_3 by rank, equal ones by ties."""
    ranked = actions.withColumn("rank", action_rank(actions))
    order = [F.desc("rank"), "name", F.size("params"), "url_template", *ties]
    first = _first(ranked, [*keys, "name", "transport", "url_template"], *order)
    nth = F.row_number().over(Window.partitionBy(*keys, "name").orderBy(*order))
    return first.withColumn("__i", nth).withColumn("name", F.when(F.col("__i") > 1, F.concat("name", F.lit("_"), F.col("__i").cast("string"))).otherwise(F.col("name"))).drop("__i")


_PARAMS = "array<struct<name:string,required:boolean>>"


def _action(name: str, kind: str, transport: str, template: Column, source: str, confidence: float, params: list[tuple[str, bool]]) -> Column:
    made = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("required")) for n, r in params]).cast(_PARAMS)
    return F.struct(
        F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(transport).alias("transport"), template.alias("url_template"),
        F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), made.alias("params"),
    )


def url_actions(targets: DataFrame) -> DataFrame:
    """Navigation for every URL; search and paginate where its query searches (and pages). Keys in sorted order decide."""
    url = F.col("url")
    base = F.regexp_replace(url, r"[?#].*$", "")
    pairs = F.filter(F.split(urls.query(url), "&"), lambda p: p != "")
    names = F.array_sort(F.transform(pairs, lambda p: F.split(p, "=")[0]))
    search = F.get(F.filter(names, is_search_key), 0)
    page = F.get(F.filter(names, is_page_key), 0)

    def template(slots: list[tuple[Column, str]], dropped: Column | None) -> Column:
        kept = pairs if dropped is None else F.filter(pairs, lambda p: F.coalesce(F.split(p, "=")[0] != dropped, F.lit(True)))

        def one(p: Column) -> Column:
            out = p
            for key, slot in slots:
                out = F.when(F.split(p, "=")[0] == key, F.concat(key, F.lit("={" + slot + "}"))).otherwise(out)
            return out

        return F.concat(base, F.lit("?"), F.array_join(F.array_sort(F.transform(kept, one)), "&"))

    made = F.array(
        _action("navigate", "navigate", "http_get", url, "url", 0.95, []),
        F.when(search.isNotNull(), _action("search", "search", "http_get", template([(search, "query")], page), "url_pattern", 0.82, [("query", True)])),
        F.when(
            search.isNotNull() & page.isNotNull(),
            _action("paginate", "paginate", "http_get", template([(search, "query"), (page, "page")], None), "url_pattern", 0.78, [("query", True), ("page", True)]),
        ),
    )
    return targets.withColumn("action", F.explode(F.filter(made, lambda a: a.isNotNull()))).select(*targets.columns, "action.*")


def form_actions(pages: DataFrame) -> DataFrame:
    """An action per form of extracted pages (url, forms): search where a field searches, else submit."""
    form = pages.select("url", F.posexplode("forms").alias("form_no", "form"))
    hidden = ["submit", "button", "image", "reset", "file"]
    form = form.withColumn("fields", F.filter("form.fields", lambda f: ~f["type"].isin(*hidden)))
    visible = F.exists("fields", lambda f: f["type"] != "hidden")
    form = form.filter((F.col("form.method") != "POST") | visible)
    searches = F.exists("fields", lambda f: (f["type"] == "search") | is_search_key(f["name"]))
    slots = F.array_join(F.transform(F.array_sort(F.transform("fields", lambda f: f["name"])), lambda n: F.concat(n, F.lit("={"), n, F.lit("}"))), "&")
    kind = F.when(searches, "search").otherwise("submit")
    return form.select(
        "url",
        F.coalesce(tx.action_name(F.col("form.name")), kind).alias("name"),
        kind.alias("kind"),
        F.when(F.col("form.method") == "GET", "http_get").otherwise("http_post").alias("transport"),
        F.concat("form.action", F.lit("?"), slots).alias("url_template"),
        F.lit("html_form").alias("source"),
        F.when(searches, 0.9).otherwise(0.75).alias("confidence"),
        F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["required"].alias("required"))).alias("params"),
    )


def schema_actions(endpoints: DataFrame) -> DataFrame:
    """An API call per endpoint of stored schemas."""
    return endpoints.select(
        "domain",
        tx.action_name(F.coalesce(F.nullif("name", F.lit("")), F.lit("call"))).alias("name"),
        F.when(F.col("url_template").contains("{query}") | F.col("url_template").contains("{q}"), "search").otherwise("fetch").alias("kind"),
        F.lit("api_call").alias("transport"),
        "url_template",
        F.lit("api_schema").alias("source"),
        F.col("confidence").cast("double").alias("confidence"),
        F.transform(F.regexp_extract_all("url_template", F.lit(r"\{(\w+)\}"), 1), lambda n: F.struct(n.alias("name"), F.lit(True).alias("required"))).alias("params"),
    )


def well_known(hosts: DataFrame, responses: DataFrame) -> DataFrame:
    """Every host's common paths in order, with the status of the response to each; null where none was captured."""
    paths = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(p).alias("path"), F.lit(kind).alias("kind")) for k, (p, kind) in enumerate(WELL_KNOWN)])
    asked = hosts.withColumn("w", F.explode(paths)).select(*hosts.columns, "w.*")
    return asked.join(responses, ["host", "path"], "left")


def suffix_lookup(hosts: DataFrame, jars: DataFrame) -> DataFrame:
    """Each host with the jar of its longest stored domain suffix (itself included)."""
    asked = hosts.select("host", F.posexplode(urls.domain_suffixes(F.col("host"))).alias("strip", "domain"))
    return _first(asked.join(jars, "domain"), ["host"], "strip")
