"""All five probe strategies in one ranking."""

from pyspark.sql import functions as F

from pagelake.functions import row_templates
from pagelake.operators import assembly, catalog


def test_known_sites_and_stores_rank_with_the_others(spark):
    sites = spark.createDataFrame([
        (1, "a", r"^a\.com$", "^/p/", "https://api.a.com/{id}", [("id", "path", r"^\d+$")]), (2, "late", ".", "^/p/", "https://late/{id}", [("id", "path", "0")]),
        (3, "fixed", r"^b\.com$", "^/$", "https://api.b.com/{v}", [("v", "fixed", "1")]),
    ], f"ord int, site string, host_pattern string, path_pattern string, api_template string, variables {row_templates.VARIABLES}")
    targets = spark.createDataFrame([("https://a.com/p/7",), ("https://a.com/p/x",), ("https://b.com/",), (None,)], "url string")
    asked = catalog.all_probe_candidates(targets, sites)
    scored = asked.withColumn("score", catalog.probe_score(F.col("strategy"), F.col("pattern"), F.col("has_headers"))).withColumns({"method": F.lit("GET"), "url_template": F.col("probe_url")})
    found = {}
    for r in catalog.rank_candidates(scored).filter("probe_url is not null").orderBy("rank").collect():
        found.setdefault(r.url, []).append((r.strategy, r.probe_url, r.score))
    assert found["https://a.com/p/7"][:3] == [("known_site", "https://api.a.com/7", 150), ("json_suffix", "https://a.com/p/7.json", 130), ("shopify", "https://a.com/products.json", 130)]
    # the first fitting rule has no id in this path, so it asks nothing; a later rule does not take its place
    assert [s for s, _, _ in found["https://a.com/p/x"]] == ["shopify", "json_suffix", "accept_header", "wp_json"]
    assert ("known_site", "https://api.b.com/1", 140) in found["https://b.com/"] and None not in found


def test_pages_of_one_url_each_have_their_site(spark):
    sites = spark.createDataFrame([(2, "late", ".", "."), (1, "first", r"^a\.com$", "^/p/")], "ord int, site string, host_pattern string, path_pattern string")
    pages = spark.createDataFrame([(1, "https://a.com/p/7"), (2, "https://a.com/p/7"), (3, "https://a.com/q"), (4, None)], "page_id int, url string")
    assert sorted(map(tuple, catalog.known_site(pages, sites).select("page_id", "site", "ord").collect())) == [(1, "first", 1), (2, "first", 1), (3, "late", 2)]
    assert catalog.known_site(pages, sites.filter("false")).count() == 0


def test_the_least_page_stands_for_a_url(spark):
    pages = spark.createDataFrame([(k, "https://a.com/p") for k in (9, 3, 7, 5)], "page_id int, url string").repartition(4)
    asked = catalog.probe_candidates(pages).withColumns({"score": F.lit(1), "method": F.lit("GET"), "url_template": F.col("probe_url")})
    assert [(r.page_id, r.rank) for r in catalog.rank_candidates(asked).orderBy("rank").collect()] == [(3, 1), (3, 2), (3, 3)]


def test_rules_do_not_move_with_urls(spark):
    """Known sites' schemas with answers: a template that is filled with nothing is answered once for all URLs, and no rule is sorted with them."""
    kinds = f"ord int, name string, host_pattern string, path_pattern string, api_url_template string, variables {row_templates.VARIABLES}"
    sites = spark.createDataFrame([(5, "all", ".", ".", "https://api/all", []), (1, "one", ".", "^/p/", "https://api/{id}", [("id", "path", "1")]), (0, "none", ".", ".", "https://api/none", [])], kinds)
    targets = spark.createDataFrame([(f"https://a.com/p/{k}",) for k in range(40)] * 2 + [(None,)], "url string")
    answers = spark.createDataFrame([("https://api/all",), ("https://api/all",), ("https://api/3",), ("https://api/other",)], "api_url string")
    found = assembly.known_site_schemas(targets, sites, answers)
    assert {r.url: r.name for r in found.collect()} == {f"https://a.com/p/{k}": "one" if k == 3 else "all" for k in range(40)} and found.count() == 40
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.name for r in assembly.known_site_schemas(targets, sites).collect()} == {"none"}
