"""The whole action catalog of URLs: what their API schemas, their query strings, forms and links let a user do.

Every source yields rows of one shape; they are united, ranked and deduplicated for each URL, and gathered in order. A URL's actions
are bounded by its schema, its forms and one page's links, so they fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from . import catalog
from .endpoints import is_pagination

PARAMS = "array<struct<name:string,place:string,type:string,required:boolean,default:string>>"
ACTION = ("name", "kind", "transport", "method", "url_template", "source", "confidence", "params")
#: Sources of actions in the order in which equal ones stand.
NAVIGATE, URL, API, DECLARED, FORM, PAGE = range(6)


def _encoded(text: Column) -> Column:
    """A text as it stands in a query: signs but letters, digits and -_.~ escaped, blanks as +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(url: Column) -> Column:
    """The decoded pairs of a URL's query in the order of their keys; broken escapes are left out."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value")))
    known = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    numbered = F.transform(known, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value")))
    return F.array_sort(numbered)


def _set(pairs: Column, key: Column, value: Column) -> Column:
    """Pairs with one value for a key, in the order of their keys."""
    others = F.filter(pairs, lambda p: p["key"] != key)
    return F.array_sort(F.concat(others, F.array(F.struct(key.alias("key"), F.lit(0).alias("at"), value.alias("value")))))


def with_query(url: Column, pairs: Column) -> Column:
    """A URL with these pairs as its query; values with slots in braces stay as they are."""
    slot = lambda v: v.contains("{") & v.contains("}")
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["key"]), F.lit("="), F.when(slot(p["value"]), p["value"]).otherwise(_encoded(p["value"])))), "&")
    base, fragment = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    return F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), fragment)


def _param(name: Column, place: Column | str, kind: str, required: Column | bool, default: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (name, lit(place), lit(kind), lit(required), F.lit(None).cast("string") if default is None else default)
    return F.struct(*[v.alias(n) for n, v in zip(("name", "place", "type", "required", "default"), values)])


def _action(at: Column, name: Column, kind: str | Column, transport: str | Column, method: str | Column, template: Column, source: str, confidence: float | Column, params: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (name, lit(kind), lit(transport), lit(method), template, lit(source), lit(confidence).cast("double"), params.cast(PARAMS))
    return F.struct(at.alias("at"), *[v.alias(n) for n, v in zip(ACTION, values)])


def _listed(rows: DataFrame, section: int, actions: Column) -> DataFrame:
    """url and the actions of a list, those that are null left out, with their section and place."""
    found = F.filter(actions, lambda a: a.isNotNull())
    return rows.select("url", F.lit(section).alias("section"), F.explode(found).alias("a")).select("url", "section", "a.*")


def navigate_actions(targets: DataFrame) -> DataFrame:
    slot = F.array(_param(F.lit("url"), "url", "string", True))
    return _listed(targets, NAVIGATE, F.array(_action(F.lit(0), F.lit("navigate"), "navigate", "http_get", "GET", F.lit("{url}"), "html_page", 0.95, slot)))


def url_actions(targets: DataFrame) -> DataFrame:
    """search, and paginate, where the query of a URL searches, and pages. Of several such keys the least decides."""
    url = F.col("url")
    rows = targets.withColumn("pairs", query_pairs(url))
    keys = F.array_distinct(F.transform("pairs", lambda p: p["key"]))
    rows = rows.withColumn("search", F.get(F.filter(keys, catalog.is_search_key), 0)).withColumn("page", F.get(F.filter(keys, catalog.is_page_key), 0))
    searched = _set(F.filter("pairs", lambda p: F.coalesce(p["key"] != F.col("page"), F.lit(True)) | (p["key"] == F.col("search"))), F.col("search"), F.lit("{query}"))
    paged = _set(F.col("pairs"), F.col("page"), F.lit("{page}"))
    there = F.col("search").isNotNull()
    return _listed(rows, URL, F.array(
        F.when(there, _action(F.lit(0), F.lit("search"), "search", "http_get", "GET", with_query(url, searched), "url_pattern", 0.82, F.array(_param(F.lit("query"), "query", "string", True)))),
        F.when(there & F.col("page").isNotNull(), _action(F.lit(1), F.lit("paginate"), "paginate", "http_get", "GET", with_query(url, paged), "url_pattern", 0.78, F.array(_param(F.lit("page"), "query", "integer", True)))),
    ))


def api_actions(schemas: DataFrame) -> DataFrame:
    """A call for each endpoint (name, method, url_template, confidence, variables, query_params) of each url's API schema."""
    def call(e: Column, at: Column) -> Column:
        slots = F.transform(F.coalesce(e["variables"], F.array()), lambda v: _param(v["name"], v["source"], "string", True))
        query = F.transform(F.coalesce(e["query_params"], F.array()), lambda q: _param(q["key"], "query", "string", F.coalesce(q["required"], F.lit(False)), q["value"]))
        name = F.coalesce(F.nullif(_name(e["name"]), F.lit("")), F.lit("api_call"))
        return _action(at, name, "api_call", "api_call", F.upper(F.coalesce(e["method"], F.lit(""))), e["url_template"], "api_schema", F.coalesce(e["confidence"].cast("double"), F.lit(0.0)), F.concat(slots.cast(PARAMS), query.cast(PARAMS)))

    return _listed(schemas, API, F.transform("endpoints", call))


def _name(text: Column) -> Column:
    """A name with _ for blanks, - and /, and none at its ends."""
    return F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), " -/", "___"), "^_+|_+$", "")


def declared_actions(schemas: DataFrame) -> DataFrame:
    """The actions that API schemas declare themselves, as they stand."""
    rows = schemas.select("url", F.lit(DECLARED).alias("section"), F.posexplode("actions").alias("at", "a"))
    return rows.select("url", "section", "at", *[F.col(f"a.{c}").alias(c) for c in ACTION[:-1]], F.col("a.params").cast(PARAMS).alias("params"))


def form_actions(pages: DataFrame) -> DataFrame:
    """A search or submit_form for each form (action, method, fields: name, type, value, required, options) of each url's page."""
    def send(form: Column, at: Column) -> Column:
        fields = F.filter(form["fields"], lambda f: ~F.lower(f["type"]).isin("submit", "button", "image", "reset", "file"))
        visible = F.exists(form["fields"], lambda f: ~F.lower(f["type"]).isin("hidden", "submit", "button", "reset", "image"))
        searches = F.filter(form["fields"], lambda f: (F.lower(f["type"]) != "hidden") & ((F.lower(f["type"]) == "search") | catalog.is_search_key(f["name"])))
        search, post = F.get(searches, 0)["name"], F.upper(form["method"]) == "POST"
        params = F.transform(fields, lambda f: _param(f["name"], F.when(post, "form").otherwise("query"), "string", f["required"] | F.coalesce(f["name"] == search, F.lit(False)), f["value"]))
        fixed = lambda f: (F.lower(f["type"]) == "hidden") | (F.lower(f["type"]) == "select")
        pairs = F.transform(fields, lambda f, i: F.struct(f["name"].alias("key"), i.alias("at"), F.when(fixed(f) & (F.coalesce(f["value"], F.lit("")) != ""), f["value"]).otherwise(F.concat(F.lit("{"), f["name"], F.lit("}"))).alias("value")))
        last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["at"] > p["at"])))
        template = F.when(post, form["action"]).otherwise(with_query(form["action"], F.array_sort(last)))
        made = _action(
            at, F.when(search.isNotNull(), "search").otherwise("submit_form"), F.when(search.isNotNull(), "search").otherwise("submit_form"), F.when(post, "http_post_form").otherwise("http_get"),
            F.when(post, "POST").otherwise("GET"), template, "html_page", F.when(search.isNotNull(), 0.9).otherwise(0.75), params,
        )
        return F.when((F.size(params) > 0) & (visible | ~post), made)

    return _listed(pages, FORM, F.transform("forms", send))


def pagination_actions(pages: DataFrame) -> DataFrame:
    """The one pagination of each page: its first link that pages and has a value of page in its query, else the url's own value."""
    value = lambda url: F.get(F.filter(query_pairs(url), lambda p: p["key"] == "page"), 0)["value"]
    links = F.filter(F.col("links"), lambda x: is_pagination(x["text"], x["href"]) & (F.coalesce(value(x["href"]), F.lit("")) != ""))
    link, own = F.get(links, 0)["href"], F.when(F.coalesce(value(F.col("url")), F.lit("")) != "", F.col("url"))
    paged = lambda url: with_query(url, _set(query_pairs(url), F.lit("page"), F.lit("{page}")))
    rows = pages.select("url", F.coalesce(link, own).alias("paged"), F.when(link.isNotNull(), 0.88).otherwise(0.7).alias("sure"))
    made = _action(F.lit(0), F.lit("paginate"), "paginate", "http_get", "GET", paged(F.col("paged")), "html_page", F.col("sure"), F.array(_param(F.lit("page"), "query", "integer", True)))
    return _listed(rows.filter("paged is not null"), PAGE, F.array(made))


def build_catalogs(targets: DataFrame, api_schemas: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per url of targets: domain, source, coverage and its actions in order.

    api_schemas: url, coverage, endpoints, actions of each url's API schema, if it has one; pages: url, links, forms of its page, if one was
    captured. source is hybrid where more actions are left than the API schema gave before repeats went, api where not, else html_extraction.
    """
    targets = targets.select("url").distinct()
    known = lambda df, *columns: targets.join(df.select("url", *columns).dropDuplicates(["url"]), "url")
    schemas, seen = known(api_schemas, "coverage", "endpoints", "actions"), known(pages, "links", "forms")
    found = navigate_actions(targets)
    for more in (url_actions(targets), api_actions(schemas), declared_actions(schemas), form_actions(seen), pagination_actions(seen)):
        found = found.unionByName(more)
    best = catalog.dedupe_actions(found.withColumn("stem", F.col("name")), ["url"], ties=("section", "at"))
    shown = F.struct((-F.col("rank")).alias("order"), "stem", F.size("params").alias("n"), "url_template", "section", "at", F.struct(*ACTION).alias("action"))
    gathered = best.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["action"]).alias("actions"))
    size = F.coalesce(F.size("endpoints"), F.lit(0)) + F.coalesce(F.size("actions"), F.lit(0))
    given = schemas.select("url", F.greatest(size, F.lit(0)).alias("n_given"), F.coalesce("coverage", F.lit("")).alias("given"))
    both = gathered.join(given, "url", "left")
    return both.select(
        urls.authority(F.col("url")).alias("domain"), "url",
        F.when(F.col("given").isNull(), "html_extraction").when(F.size("actions") > F.col("n_given"), "hybrid").otherwise("api").alias("source"),
        F.coalesce(F.nullif("given", F.lit("")), F.lit("partial")).alias("coverage"), "actions",
    )
