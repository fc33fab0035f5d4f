"""Pattern matching by wildcard masks against a test of every pattern."""

import random

from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.operators import catalog

SCHEMA = "domain string, url_pattern string, ord int"


def brute(targets, patterns):
    def parts(p):
        return [s for s in p.split("/") if s]

    out = {}
    for url, path in targets:
        fits = [(-sum(1 if s == "{}" else 10 for s in parts(p)), o, p) for d, p, o in patterns if d == "a.com" and len(parts(p)) == len(parts(path)) and all(s in ("{}", u) for s, u in zip(parts(p), parts(path)))]
        if fits:
            out[url] = min(fits)[2]
    return out


def test_index_finds_what_a_test_of_all_patterns_finds(spark):
    rng = random.Random(4)
    words = ["x", "y", "zed", "{}"]
    patterns = [("a.com" if k % 5 else "b.com", "/" + "/".join(rng.choice(words) for _ in range(rng.randrange(0, 5))), k) for k in range(200)]
    paths = ["/" + "/".join(rng.choice(["x", "y", "zed", "other", "12345"]) for _ in range(rng.randrange(0, 5))) for _ in range(150)]
    targets = [(f"https://a.com{p}", p) for p in sorted(set(paths))]
    found = catalog.match_patterns(spark.createDataFrame(targets, "url string, p string"), spark.createDataFrame(patterns, SCHEMA)).collect()
    normal = spark.createDataFrame(targets, "url string, p string").select("url", urls.normalize_path(F.col("p")).alias("n")).collect()
    assert {r.url: r.url_pattern for r in found} == brute([(r.url, r.n) for r in normal], patterns)


def test_rows_grow_with_what_fits(spark):
    """50,000 patterns of one domain and three masks; a target meets as many rows as fit it."""
    patterns = spark.range(50_000).select(F.lit("a.com").alias("domain"), F.concat(F.lit("/p/"), F.col("id"), F.when(F.col("id") % 2 == 0, "/{}").otherwise("/tail")).alias("url_pattern"), F.col("id").cast("int").alias("ord"))
    patterns = patterns.unionByName(spark.createDataFrame([("a.com", "/p/{}/{}", 99_999)], SCHEMA))
    targets = spark.range(20_000).select(F.concat(F.lit("https://a.com/p/"), F.lit("w"), F.col("id"), F.lit("/tail")).alias("url"))
    named = patterns.withColumn("url_pattern", F.regexp_replace("url_pattern", "/p/([0-9])", "/p/w$1"))
    assert catalog.pattern_hits(targets, named).count() == 20_000 * 2
    plan = catalog.pattern_hits(targets, named)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "NestedLoop" not in plan
    assert catalog.match_patterns(targets.limit(1), named).first().url_pattern in ("/p/w0/{}", "/p/{}/{}")


def test_nulls_and_empty_tables(spark):
    targets = spark.createDataFrame([(None,), ("",), ("https://a.com",), ("https://a.com/",)], "url string")
    patterns = spark.createDataFrame([("a.com", "/", 1), ("a.com", None, 2), (None, "/", 3)], SCHEMA)
    assert {(r.url, r.ord) for r in catalog.pattern_hits(targets, patterns).collect()} == {("https://a.com", 1), ("https://a.com/", 1)}
    assert catalog.pattern_hits(targets, patterns.limit(0)).count() == 0


def test_the_least_page_stands_for_a_url(spark):
    pages = spark.createDataFrame([(k, f"https://a.com/{p}/b") for p in "xy" for k in (9, 3, 7, 5)], "page_id int, url string").repartition(4)
    stored = spark.createDataFrame([("a.com", "/x/b", 1), ("a.com", "/{}/b", 2)], SCHEMA)
    found = catalog.match_patterns(pages, stored).select("url", "page_id", "url_pattern").collect()
    assert sorted(map(tuple, found)) == [("https://a.com/x/b", 3, "/x/b"), ("https://a.com/y/b", 3, "/{}/b")]
