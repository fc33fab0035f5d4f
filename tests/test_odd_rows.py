"""Odd rows, held against the registered SQL as it is. The keys pass its row filters."""

import duckdb
import pytest

from pagelake import plans

#: Line ends for Java, which RE2 takes for signs like any other (but for the line feed).
ENDS = ["\r", "\r\n", "\n", "\u0085", "\u2028", "\u2029"]


def differences(spark, folder, name):
    """Rows only in the query and only in its SQL."""
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}/*.parquet'")
    result = con.execute(plans.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    found, expected = [tuple(r) for r in plans.QUERIES[name](spark, str(folder)).select(*names).collect()], result.fetchall()
    assert expected
    return sorted(set(found) - set(expected), key=repr), sorted(set(expected) - set(found), key=repr), len(found) - len(expected)


def write(spark, folder, table, rows, columns):
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(folder / f"{table}.parquet"))


@pytest.fixture(scope="module")
def line_ends(spark, tmp_path_factory):
    """Urls, all different, with a line end in or behind the path, the query, the fragment and the host."""
    folder = tmp_path_factory.mktemp("line_ends")
    shapes = ["/x{}y", "/en/12{}", "/{}", "//{}", "?q=1{}", "?q={}/z", "#a{}", "#{}?b", "{}", ":80{}", ":80/a{}/7.html", "/de/7.html{}"]
    urls = [f"https://www.h{i}x{k}.example.net" + s.format(e) for i, s in enumerate(shapes) for k, e in enumerate(ENDS)]
    html = "<html lang=\"en\"><head><title>t</title></head><body><h1>h</h1></body></html>"
    write(spark, folder, "pages", [(12 * k, u, html) for k, u in enumerate(urls, 1)], "page_id bigint, url string, html string")
    return folder


@pytest.mark.parametrize("name", ["rules_by_domain", "url_normalize_host", "domain_semi_join", "domain_anti_join"])
def test_hosts_of_urls_with_line_ends(spark, line_ends, name):
    assert differences(spark, line_ends, name) == ([], [], 0)


@pytest.mark.parametrize("name", ["probe_candidates_all", "probe_candidates_ranked"])
def test_probes_of_urls_with_line_ends_or_no_host(spark, tmp_path, name):
    shapes = ["/x?q=1{}", "/x/?q={}&z", "/x#a{}", "/x#{}?b", "/x/{}", "/en/12/{}?q=1{}", "/x{}/"]
    urls = [f"https://h{i}x{k}.example.net" + s.replace("{}", e) for i, s in enumerate(shapes) for k, e in enumerate(ENDS)]
    urls += ["a/b", "/a/b/?q=1", "https:///a/12", "https://", "//h.example.net/a", "", None]
    write(spark, tmp_path, "pages", [(12 * k, u) for k, u in enumerate(urls, 1)], "page_id bigint, url string")
    assert differences(spark, tmp_path, name) == ([], [], 0)
    if name == "probe_candidates_all":
        asked = plans.QUERIES[name](spark, str(tmp_path)).filter("probe_url is null")
        assert [r.page_id for r in asked.collect()] == [12 * len(urls)]  # nothing is asked only without a url


@pytest.mark.parametrize("name", ["page_headings", "page_title_lang", "rules_by_domain"])
def test_texts_that_end_in_separators(spark, tmp_path, name):
    """U+001C to U+001F are no blanks: neither the reference nor the SQL takes them off."""
    texts = ["\x1ca\x1f", "\x1d", "a\x1e ", " \x1fb", "a &amp; b"]
    pages = [(k, f"https://h{k % 3}.example.net/{k}", f'<html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1></body></html>') for k, t in enumerate(texts)]
    write(spark, tmp_path, "pages", pages, "page_id bigint, url string, html string")
    assert differences(spark, tmp_path, name) == ([], [], 0)


def test_pages_without_title_or_language(spark, tmp_path):
    pages = ["<html><body>x</body></html>", '<html lang=""><head><title></title></head><body></body></html>', "", None, '<html lang="en"><head></head><body></body></html>']
    write(spark, tmp_path, "pages", [(k, f"https://h/{k}", h) for k, h in enumerate(pages)], "page_id bigint, url string, html string")
    assert differences(spark, tmp_path, "page_title_lang") == ([], [], 0)


def orders(spark, folder, rows):
    write(spark, folder, "orders", rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    return str(folder)


def test_an_order_without_a_key_is_no_primary_endpoint(spark, tmp_path):
    """The registered SQL has nulls last; its row filter leaves such orders out, so the result is written down here."""
    d = orders(spark, tmp_path, [(7, 1, "O", 1000.0), (None, 1, "O", 1000.0), (None, 2, "O", 1000.0), (11, 3, "F", 1000.0), (None, 3, "F", 400000.0)])
    found = {r.domain: (r.ord, r.is_primary) for r in plans.QUERIES["primary_endpoints"](spark, d).collect()}
    # one that is marked comes before all others, with a key or without
    assert found == {"h1.example.com": (7, False), "h2.example.com": (None, False), "h3.example.com": (None, True)}


def test_endpoints_of_one_ord_are_ranked_by_template(spark, tmp_path):
    status = "ZYXWVUTSRQPONMLKJIHGFEDCBA"
    d = orders(spark, tmp_path, [(k, 1, s, 970.0 * 3 + 80) for s in status for k in (6, None)])
    found = plans.QUERIES["endpoint_rank"](spark, d).orderBy("rank").collect()
    assert [r.rank for r in found] == list(range(1, 53)) and [r.is_primary for r in found] == [True] + [False] * 51
    assert [r.url_template for r in found] == [f"/api/{s}/6" for s in sorted(status.lower())] + [f"/api/{s}/" for s in sorted(status.lower())]
