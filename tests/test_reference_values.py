"""Values of the behaviour that is to be matched: scores, merges, addresses, sizes."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from pagelake.functions import semantics, urls
from pagelake.functions import text as tx
from pagelake.operators import catalog, schemas


def column(spark, rows, make, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).coalesce(1).select(make(F.col("x"))).collect()]


def test_addresses(spark):
    blocked = [
        None, "", "nonsense", "300.1.1.1", "1.2.3", "01.2.3.4", "127.0.0.1", "10.1.1.1", "172.31.0.1", "192.168.9.9", "169.254.169.254", "100.127.0.1", "224.0.0.1", "239.1.1.1", "0.0.0.0",
        "::", "::1", "0:0:0:0:0:0:0:1", "fe80::1", "febf::1", "fc00::1", "fdff::", "ff02::1", "::ffff:10.0.0.1", "::FFFF:7f00:1", "0:0:0:0:0:ffff:192.168.0.1", "1::2::3", "12345::1",
    ]
    open_ = ["8.8.8.8", "250.1.1.1", "0.1.2.3", "172.32.0.1", "100.128.0.1", "192.169.0.1", "2001:db8::1", "::2", "::ffff:8.8.8.8", "::ffff:808:808", "fec0::1", "1:2:3:4:5:6:7:8"]
    assert column(spark, blocked, urls.private_ip) == [True] * len(blocked)
    assert column(spark, open_, urls.private_ip) == [False] * len(open_)


def test_sizes(spark):
    found = {0: "0B", 5: "5B", 1023: "1023B", 1024: "1.0KB", 1280: "1.2KB", 1344: "1.3KB", 1 << 20: "1.0MB", (1 << 20) - 1: "1024.0KB", 1 << 31: "2.0GB", 3 << 40: "3.0TB", 5 << 50: "5.0PB", 7 << 60: "7.0EB"}
    assert column(spark, list(found), tx.human_bytes, "x bigint") == list(found.values())


def test_secrets(spark):
    assert column(spark, ["", "abcdijkl1234", "x" * 16, "abcdefghijklmnopq"], tx.redact) == ["<redacted>"] * 3 + ["abcdefgh…nopq"]


def test_entity_types(spark):
    names = ["listSearch", "Listing", "getRepo", "my_product", "items", "users", None]
    assert column(spark, names, schemas.entity_type) == ["search_results", "list", "entity", "entity", "entity", "object", "object"]
    assert column(spark, names, lambda n: schemas.entity_type(n, F.lit("array")))[-2:] == ["list", "list"]


def test_hmac(spark):
    keys = ["", "k", "é" * 20, "x" * 64, "x" * 65]
    rows = [(k, m) for k in keys for m in ("", "message ü")]
    found = spark.createDataFrame(rows, "k string, m string").select(schemas.hmac_sha256(F.col("k"), F.col("m"))).collect()
    assert sorted(r[0] for r in found) == sorted(hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in rows)


TARGET = "https://Shop.example/Acme/Blue-Shoes.json?id=42&tag=Red%20Hat"


@pytest.mark.parametrize("url, score", [
    ("https://x.example/acme/blue-shoes.json/", 0.72), ("https://x.example/api/acme/blue-shoes", 0.66), ("https://x.example/other/blue-shoes", 0.58),
    ("https://blue-shoes.example.com/other", 0.0), ("https://x.example/", 0.0),
])
def test_url_rungs(spark, url, score):
    row = spark.range(1).select(semantics.url_score(semantics.target_signals(F.lit(TARGET)), F.lit(url)).alias("s")).first()
    assert float(row.s) == score


def test_json_of_the_target_is_its_url(spark):
    row = spark.range(1).select(semantics.url_score(semantics.target_signals(F.lit("https://a.example/r/top/")), F.lit("https://b.example/r/Top.json")).alias("s")).first()
    assert float(row.s) == 0.82


@pytest.mark.parametrize("body, score", [
    ('{"u": " https://shop.example/acme/blue-shoes.json?id=42&TAG=red%20hat "}', 1.0), ('{"u": "http://other.example/acme/blue-shoes.json"}', 1.0),
    ('{"u": "https://o.example/x/acme/blue-shoes"}', 0.88), ('{"Full_Name": "the acme/blue-shoes one"}', 0.95), ('{"slug": "Blue-Shoes"}', 0.9),
    ('{"x": "these blue-shoes here"}', 0.84), ('{"x": "red hat"}', 0.94), ('{"x": {"item_id": 42}}', 0.96), ('{"x": 42}', 0.0), ('{"id": 42.0}', 0.96),
    ('{"a": {"b": {"c": {"d": {"id": 42}}}}}', 0.96), ('{"a": {"b": {"c": {"d": {"e": {"id": 42}}}}}}', 0.0), ("not json", 0.0), ("[" + "0," * 12 + '"red hat"]', 0.0),
    ("[" + "0," * 11 + '"red hat"]', 0.94),
])
def test_body_rungs(spark, body, score):
    row = spark.range(1).select(semantics.body_score(semantics.target_signals(F.lit(TARGET)), F.lit(body)).alias("s")).first()
    assert float(row.s) == score


def test_no_signals(spark):
    row = spark.range(1).select(semantics.semantic_score(F.lit("https://a.example/"), F.lit("https://a.example/x"), F.lit("{}")).alias("s")).first()
    assert float(row.s) == 0.6


def folded(rows):
    """Endpoints in order, folded one by one."""
    out = {}
    for r in rows:
        key = (r["domain"], (r["method"] or "").upper(), r["url_template"], r["body_template"] or "")
        if key not in out:
            out[key] = dict(r, headers=dict(r["headers"] or {}), method=r["method"] or "", name=r["name"] or "", description=r["description"] or "")
            continue
        e = out[key]
        if e["name"] in ("", "directJSON"):
            e["name"] = r["name"] or ""
        if e["description"] == "" or (e["description"] == e["name"] and r["description"]):
            e["description"] = r["description"] or ""
        e["method"] = r["method"] or e["method"]
        e["headers"].update(r["headers"] or {})
        e["query_params"] = e["query_params"] or r["query_params"]
        e["body"] = r["body"] if e["body"] is None else e["body"]
        e["confidence"] = max(e["confidence"], r["confidence"])
    best = {}
    for key, e in out.items():
        if key[0] not in best or e["confidence"] > out[best[key[0]]]["confidence"]:
            best[key[0]] = key
    return {key: (e["name"], e["description"], e["method"], e["headers"], e["query_params"] or {}, e["body"], e["confidence"], best[key[0]] == key) for key, e in out.items()}


def test_merge_endpoints(spark):
    rng = random.Random(6)
    schema = "domain string, method string, url_template string, body_template string, name string, description string, headers map<string,string>, query_params map<string,string>, body string, confidence double, is_primary boolean, ord int"
    pick = lambda *x: rng.choice(x)
    names = [x.split()[0] for x in schema.split(", ")]
    row = lambda k: (pick("a", "b"), pick("get", "GET", None), pick("/x", "/y"), pick(None, "{}"), pick("", "directJSON", "Foo", None), pick("", "Foo", "long", None), {pick("h", "i"): str(k)}, pick({}, {"q": str(k)}, None), pick(None, f"b{k}"), rng.randrange(5) / 4, False, k)
    sides = [[row(k) for k in range(30)] for _ in range(2)]
    found = catalog.merge_endpoints(*[spark.createDataFrame(s, schema) for s in sides]).collect()
    got = {(r.domain, r.method.upper(), r.url_template, r.body_template): (r.name, r.description, r.method, r.headers, r.query_params or {}, r.body, r.confidence, r.is_primary) for r in found}
    assert len(got) == len(found) and got == folded([dict(zip(names, r)) for s in sides for r in s])
