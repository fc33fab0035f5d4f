"""Queries read every row of their input: held against brute force, as the registered SQL of some reads a part of it."""

import json
import pathlib

import duckdb
import pytest

from pagelake import plans
from pagelake.plans import views

DATA = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
#: Row filters in the registered SQL; the SQL without them covers the whole table.
FILTERS = (
    " WHERE page_id % 3 = 0", " WHERE page_id % 5 = 0", " WHERE (page_id + length(strategy)) % 4 <> 0", " WHERE ord % 3 = 0",
    " WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 1", " WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 1",
)


def rows(spark, name):
    return [r.asDict() for r in plans.QUERIES[name](spark, str(DATA)).collect()]


@pytest.fixture(scope="module")
def har(spark):
    return [r.asDict() for r in views.har(spark, str(DATA)).orderBy("capture_id", "ord").collect()]


def test_har_included_merge(spark, har):
    seen, expected = set(), []
    for r in har:
        urn = f"u{r['ord'] % 7}"
        if (r["capture_id"], urn) not in seen:
            expected.append((r["capture_id"], r["ord"], 0, urn))
        seen.add((r["capture_id"], urn))
        expected.append((r["capture_id"], r["ord"], 1, ""))
    found = [(r["capture_id"], r["ord"], r["pos"], r["urn"] or "") for r in rows(spark, "har_included_merge")]
    assert sorted(found) == sorted(expected)


def test_responses_by_endpoint(spark, tmp_path):
    events = [(0, 1, "click"), (1, 1, "click"), (2, 1, "view"), (3, 2, "error"), (4, 2, "view"), (5, 3, "signup")]
    columns = "event_id bigint, user_id bigint, event_type string, props string, ts string"
    spark.createDataFrame([(*e, "{}", "2024-01-01") for e in events], columns).write.parquet(str(tmp_path / "events.parquet"))
    found = {r.capture_id: r.data and json.loads(r.data) for r in plans.QUERIES["responses_by_endpoint"](spark, str(tmp_path)).collect()}
    # the last click is odd, an odd failure makes its capture null, and a capture of odd rows only is there
    assert found == {1: {"click": {"n": 1}, "view": {"n": 2}}, 2: None, 3: {"signup": {"n": 5}}}


def test_responses_are_in_the_order_of_names(spark, tmp_path):
    """All ids are even, so the registered SQL reads every row. A name may begin another; a response without a name is no member."""
    names = ["list", "list all", "list!", "Z", "é", None, "list"]
    events = [(2 * k, 1, n) for k, n in enumerate(names)] + [(20, 2, None), (22, 3, "a"), (24, 3, None), (26, 4, "error"), (30, None, "b")]
    columns = "event_id bigint, user_id bigint, event_type string, props string, ts string"
    spark.createDataFrame([(*e, "{}", "2024-01-01") for e in events], columns).write.parquet(str(tmp_path / "events.parquet"))
    found = {r.capture_id: r.data for r in plans.QUERIES["responses_by_endpoint"](spark, str(tmp_path)).collect()}
    assert list(json.loads(found[1])) == ["Z", "list", "list all", "list!", "é"] and json.loads(found[1])["list"] == {"n": 12}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert found == dict(con.execute(plans.ORACLE_SQL["responses_by_endpoint"]).fetchall())


def test_patterns_of_urls_with_line_ends(spark, tmp_path):
    """The keys pass the row filter of the registered SQL, which is run as it is. A line end at the end of a segment is part of it."""
    ends = ["", "\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029", "\x0b", " "]
    paths = [p + e for e in ends for p in ("/7/12", "/7/12/", "/7/0123456789abcdef", "/7/123e4567-e89b-12d3-a456-426614174000", "/x/12/y")]
    pages = spark.read.parquet(f"{DATA}/pages.parquet").selectExpr("page_id * 3 page_id", "url", "html")
    odd = [(-3 * k, f"https://h{k}.com{p}" if k % 2 else f"https://h.com{p}", "") for k, p in enumerate(paths, 1)]
    pages.unionByName(spark.createDataFrame(odd, "page_id int, url string, html string")).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("pattern_match_best", "url_dynamic_segments"):
        result = con.execute(plans.ORACLE_SQL[name])
        names = [x[0] for x in result.description]
        assert sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).select(*names).collect())) == sorted(result.fetchall()), name


@pytest.mark.parametrize("name", ["url_semantic_score", "probe_candidates_ranked", "pattern_match_best", "schema_lookup_priority", "schema_ttl_expired", "schema_store_if_no_api", "schemas_per_domain", "endpoint_fill", "endpoint_rank", "primary_endpoints", "catalog_union"])
def test_catalog(spark, name):
    sql = plans.ORACLE_SQL[name]
    for part in FILTERS:
        sql = sql.replace(part, "")
    con = duckdb.connect()
    for table in ("pages", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    expected = [dict(zip(names, r)) for r in result.fetchall()]
    key = lambda r: repr(sorted(r.items()))
    assert sorted(rows(spark, name), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize(("name", "times", "plus"), [("endpoint_fill", 6, 0), ("endpoint_rank", 6, 0), ("catalog_union", 6, 0), ("primary_endpoints", 2, 1)])
def test_orders_without_a_customer_or_status(spark, tmp_path, name, times, plus):
    """The keys pass the row filters of the registered SQL, which is run as it is."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT o_orderkey * {times} + {plus} AS o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM '{DATA}/orders.parquet') TO '{tmp_path}/orders.parquet'""")
    con.execute(f"COPY (SELECT * FROM '{DATA}/pages.parquet') TO '{tmp_path}/pages.parquet'")
    for table in ("pages", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    result = con.execute(plans.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    key = lambda r: repr(sorted(r.items()))
    expected = sorted((dict(zip(names, r)) for r in result.fetchall()), key=key)
    assert sorted((r.asDict() for r in plans.QUERIES[name](spark, str(tmp_path)).collect()), key=key) == expected


def test_traffic_documents(spark, har):
    expected, n = {}, {}
    for r in har:
        k = n[r["capture_id"]] = n.get(r["capture_id"], 0) + 1
        if k <= 25:
            entry = f"## {k}. {r['method']} {r['url']}\nstatus {r['status']}\n{(r['body'] or '').encode()[:500].decode(errors='ignore')}"
            expected.setdefault(r["capture_id"], []).append(entry)
    assert {r["capture_id"]: r["document"] for r in rows(spark, "traffic_documents")} == {k: "\n\n".join(x) for k, x in expected.items()}
