"""Encodings against Python's, envelopes, and the classes of schemas."""

import base64
import hashlib

from pyspark.sql import functions as F

from pagelake.functions import codecs
from pagelake.operators import catalog


def test_texts_go_there_and_back(spark):
    texts = ["", "a", "ab", "abc", "é?>~", "x" * 200, "ÿÿÿ>>>???"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", codecs.sha1_hex(F.col("t")).alias("s"), codecs.base64_text(F.col("t")).alias("b"), codecs.base64_url(F.col("t")).alias("u"), codecs.hex_text(F.col("t")).alias("h"))
    back = found.select("*", *[codecs.from_base64(c).alias(n) for n, c in (("b0", F.col("b")), ("u0", F.col("u")), ("p0", F.regexp_replace("b", "=", "")), ("l0", F.concat(F.col("b"), F.lit("\n"))))], codecs.from_hex(F.upper("h")).alias("h0"))
    for r in back.collect():
        data = r.t.encode()
        assert (r.s, r.b, r.u, r.h) == (hashlib.sha1(data).hexdigest(), base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("="), data.hex())
        assert r.b0 == r.u0 == r.p0 == r.l0 == r.h0 == r.t


def test_what_is_no_encoding(spark):
    rows = spark.createDataFrame([("a",), ("ab=",), ("+_aa",), ("a b=",), ("====",), (None,)], "t string")
    assert [r[0] for r in rows.select(codecs.from_base64(F.col("t"))).collect()] == [None] * 6
    odd = spark.createDataFrame([("abc",), ("zz",), (None,)], "t string")
    assert [r[0] for r in odd.select(codecs.from_hex(F.col("t"))).collect()] == [None] * 3


def test_envelopes(spark):
    bodies = ['{"success": true, "data": {"a": [1]}}', '{"success": true}', '{"success": false, "data": 1, "error": {"code": "c", "message": "m"}}', '{"error": null}', "[]", "", None]
    found = [tuple(r.e) for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(codecs.unwrapped(F.col("b")).alias("e")).collect()]
    assert found == [(True, '{"a":[1]}', None, None), (True, None, None, None), (False, None, "c", "m")] + [(False, None, "", "")] * 4


def test_schema_classes(spark):
    cases = [("api", 0, None, "api"), ("css", 0, "{}", "css"), ("css", 3, '{"strategy":"next_data"}', "next_data"), ("", 2, None, "api"), (None, 0, '{"strategy":"css_selector"}', "css"), ("", 2, '{"strategy":"next_data"}', "next_data"), ("", 0, None, "other"), ("api", 1, '{"strategy":"next_data"}', "api")]
    rows = spark.createDataFrame(cases, "t string, n int, r string, want string")
    assert all(r[0] == r[1] for r in rows.select(catalog.schema_class(F.col("t"), F.col("n"), F.col("r")), "want").collect())
