"""Page extraction: records, links, texts, rules and structured output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, extract, rules, structured
from ..sources.tables import read_table

_RULES = rules.Rules(
    content_selector="article", title_selector="h1", ignore_selectors=("nav", "footer", ".ad"), page_type="article",
    fields=(rules.Field("first_link", "nav a", attribute="href"),),
    entity_fields=(rules.Field("links", "a", type="list", item_fields=(rules.Field("text", ""), rules.Field("href", "a", attribute="href"))), rules.Field("heading", ".none", ("h1",), required=True), rules.Field("price", ".price", type="number", required=True)),
)


def _pages(spark, d):
    return read_table(spark, d, "pages")


def _rich(spark, d):
    """Pages with a form, a table, metadata and embedded state put before their article, but for every fourth page. Every
    third lacks one of two states, every fifth has a broken product, and every second a required field."""
    i, k = F.col("page_id"), F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<form action="/search" name="Find It"><input name="q"'), F.when(i % 2 == 0, " required").otherwise(""), F.lit('><input type="hidden" name="lang" value="l'), k,
        F.lit('"><select name="sort"><option value="a">A</option><option selected>B'), k, F.lit('</option></select></form><table id="t"><tr><td class="n">'), k, F.lit('</td><td>x</td></tr><tr><td>sub '), k,
        F.lit("</td></tr><tr><td>tail</table><script>"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit('var ytInitialData = {"id":'), k, F.lit(',"a":undefined};'))),
        F.lit('window.__APOLLO_STATE__={"x":[1,'), k, F.lit(']}</script><script type="application/ld+json">{"@type":"Product","name":"P'), k, F.when(i % 5 == 0, '","price').otherwise(F.concat(F.lit('","price":'), k, F.lit("}"))), F.lit("</script>"),
    )
    meta = F.concat(F.lit('<meta property="og:type" content="product"><meta name="keywords" content="k'), k, F.lit('"><link rel="canonical" href="/c/'), k, F.lit('"></head>'))
    html = F.replace(F.replace("html", F.lit("</head>"), meta), F.lit("<article>"), F.concat(extra, F.lit("<article>")))
    return _pages(spark, d).withColumn("html", F.when(i % 4 == 1, F.col("html")).otherwise(html))


def page_records(spark, d):
    fields = ("title", "language", "headings", "links", "body_text", "has_article")
    found = extract.extract_pages(_pages(spark, d), fields)
    return found.select("page_id", "title", "language", F.size("headings").alias("n_headings"), F.size("links").alias("n_links"), F.octet_length("body_text").alias("text_bytes"), "has_article")


def page_title_lang(spark, d):
    """Empty where a page has none, null where there is no html."""
    pages = _pages(spark, d).withColumn("none", F.when(F.col("html").isNotNull(), ""))
    return extract.extract_pages(pages, ("title", "language")).select("page_id", *[F.coalesce(c, "none").alias(c) for c in ("title", "language")])


def page_headings(spark, d):
    found = extract.extract_pages(_pages(spark, d), ("headings",))
    return found.select("page_id", F.explode("headings").alias("h")).select("page_id", "h.level", "h.text")


def page_links(spark, d):
    found = extract.extract_pages(_pages(spark, d), ("links",))
    return found.select("page_id", F.explode("links").alias("l")).select("page_id", "l.text", "l.href")


def page_body_text(spark, d):
    return extract.extract_pages(_pages(spark, d), ("body_text",)).select("page_id", "body_text")


def page_forms(spark, d):
    found = extract.extract_pages(_rich(spark, d), ("forms",))
    field = found.select("page_id", F.explode("forms").alias("f")).select("page_id", "f.name", "f.method", F.explode("f.fields").alias("x"))
    return field.select("page_id", "name", "method", F.col("x.name").alias("field"), "x.type", "x.value", "x.required", F.array_join("x.options", ",").alias("options"))


def page_embedded(spark, d):
    found = extract.extract_pages(_rich(spark, d), ("embedded_scripts",))
    return found.select("page_id", F.explode("embedded_scripts").alias("name", "json"))


def page_pattern(spark, d):
    return extract.extract_pattern(_rich(spark, d), "ytInitialData").select("page_id", "pattern_json")


def page_meta(spark, d):
    found = extract.extract_pages(_rich(spark, d), ("open_graph", "meta", "json_ld", "canonical"))
    return found.select("page_id", F.try_element_at("open_graph", F.lit("type")).alias("og_type"), F.try_element_at("meta", F.lit("keywords")).alias("keywords"), F.size("json_ld").alias("n_ld"), F.regexp_extract("canonical", "/c/[0-9]+$", 0).alias("canonical"))


def page_structured(spark, d):
    return structured.structure_pages(_rich(spark, d)).select("page_id", "source", "page_type", F.get_json_object("record", "$.price").alias("price"), F.get_json_object("record", "$.data.ytInitialData.id").alias("state_id"))


def content_useful(spark, d):
    found = extract.extract_pages(_pages(spark, d), ("embedded_scripts", "headings", "has_article", "json_ld", "links", "body_text"))
    return found.select("page_id", structured.is_useful(found).alias("useful"))


def rules_content(spark, d):
    return rules.extract_content(_pages(spark, d), _RULES).select("page_id", "title", F.octet_length("content").alias("n_bytes"), "fields")


def rules_extract(spark, d):
    found = rules.extract_entities(_rich(spark, d), _RULES)
    return found.select("page_id", F.get_json_object("data", "$.type").alias("type"), (F.get_json_object("data", "$.heading") == F.get_json_object("data", "$.title")).alias("same"), F.array_join("missing_required", ",").alias("missing"))


def table_rows(spark, d):
    rule = rules.Rules(container="#t", group_size=2, row_fields=(rules.Field("id", ".n", type="number", required=True), rules.Field("sub", "td", row=1), rules.Field("none", ".zz", required=True)))
    found = rules.extract_rows(_rich(spark, d), rule)
    return found.select("page_id", F.get_json_object("data", "$.items[0].id").alias("id"), F.get_json_object("data", "$.items[0].sub").alias("sub"), F.get_json_object("data", "$.items[1].sub").alias("tail"), F.array_join("missing_required", ",").alias("missing"))


def select_nodes(spark, d):
    found = rules.select_nodes(_pages(spark, d), "nav li:first-child > a[href^='/']")
    return found.select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.tag", "n.text")


def form_actions(spark, d):
    found = catalog.form_actions(extract.extract_pages(_rich(spark, d).withColumn("page", F.col("url")), ("forms",)))
    return found.select("url", "name", "kind", "transport", F.regexp_extract("url_template", "/search.*$", 0).alias("template"), "confidence")


QUERIES = {f.__name__: f for f in (
    page_records, page_title_lang, page_headings, page_links, page_body_text, page_forms, page_embedded, page_pattern, page_meta, page_structured,
    content_useful, rules_content, rules_extract, table_rows, select_nodes, form_actions,
)}

_UNESC = lambda x: f"replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"

ORACLE_SQL = {
    "page_title_lang": f"""
SELECT page_id, trim({_UNESC("regexp_extract(html, '<title>(.*?)</title>', 1)")}) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""",
    "page_headings": f"""
SELECT page_id, CAST(1 AS INTEGER) AS level, trim({_UNESC("h")}) AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h1>(.*?)</h1>', 1)) AS h FROM pages) WHERE trim(h) <> ''""",
    "page_links": f"""
SELECT page_id, arg_min(text, i) AS text, href FROM (
  SELECT page_id, i, trim({_UNESC("regexp_extract(a, '>(.*?)</a>', 1)")}) AS text,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || {_UNESC("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href
  FROM (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="/[^"]*">.*?</a>') AS l FROM pages))
) GROUP BY page_id, href""",
    "page_forms": """
SELECT page_id, 'Find It' AS name, 'GET' AS method, field, type, CASE field WHEN 'lang' THEN 'l' || page_id WHEN 'sort' THEN 'B' || page_id ELSE '' END AS value,
  field = 'q' AND page_id % 2 = 0 AS required, CASE WHEN field = 'sort' THEN 'a,B' || page_id END AS options
FROM pages, (VALUES ('q', 'text'), ('lang', 'hidden'), ('sort', 'select')) AS f(field, type) WHERE page_id % 4 <> 1""",
    "page_embedded": """
SELECT page_id, 'ytInitialData' AS name, '{"a":null,"id":' || page_id || '}' AS json FROM pages WHERE page_id % 4 <> 1 AND page_id % 3 <> 0
UNION ALL SELECT page_id, '__APOLLO_STATE__', '{"x":[1,' || page_id || ']}' FROM pages WHERE page_id % 4 <> 1""",
    "page_pattern": """SELECT page_id, CASE WHEN page_id % 4 <> 1 AND page_id % 3 <> 0 THEN '{"a":null,"id":' || page_id || '}' END AS pattern_json FROM pages""",
    "page_meta": """
SELECT page_id, CASE WHEN page_id % 4 <> 1 THEN 'product' END AS og_type, CASE WHEN page_id % 4 <> 1 THEN 'k' || page_id END AS keywords,
  CAST(CASE WHEN page_id % 4 <> 1 AND page_id % 5 <> 0 THEN 1 END AS INTEGER) AS n_ld, CASE WHEN page_id % 4 <> 1 THEN '/c/' || page_id END AS canonical FROM pages""",
    "page_structured": """
SELECT page_id, CASE WHEN page_id % 4 <> 1 THEN 'embedded' ELSE 'body' END AS source, CASE WHEN page_id % 4 <> 1 THEN 'product' ELSE 'article' END AS page_type,
  CASE WHEN page_id % 4 <> 1 AND page_id % 5 <> 0 THEN CAST(page_id AS VARCHAR) END AS price, CASE WHEN page_id % 4 <> 1 AND page_id % 3 <> 0 THEN CAST(page_id AS VARCHAR) END AS state_id FROM pages""",
    "rules_extract": "SELECT page_id, 'article' AS type, true AS same, 'price' AS missing FROM pages",
    "table_rows": """
SELECT page_id, CASE WHEN here THEN CAST(page_id AS VARCHAR) END AS id, CASE WHEN here THEN 'sub ' || page_id END AS sub, CAST(NULL AS VARCHAR) AS tail, CASE WHEN here THEN 'none' END AS missing
FROM (SELECT page_id, page_id % 4 <> 1 AS here FROM pages)""",
    "select_nodes": f"""
SELECT page_id, 'a' AS tag, {_UNESC("regexp_extract(html, '<nav><ul><li><a href=\"/[^\"]*\">(.*?)</a>', 1)")} AS text FROM pages WHERE regexp_matches(html, '<nav><ul><li><a href=\"/')""",
    "form_actions": """
SELECT url, 'find_it' AS name, 'search' AS kind, 'http_get' AS transport, '/search?lang={lang}&q={q}&sort={sort}' AS template, CAST(0.9 AS DOUBLE) AS confidence FROM pages WHERE page_id % 4 <> 1""",
}
