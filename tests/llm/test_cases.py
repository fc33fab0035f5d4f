"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, fingerprints, lines, near, packing, quotes, suffixes, toxicity, urls, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, host string, spans string, n string, s string, class_no string, key string"
LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))


def documents(spark, rows):
    full = [(i, t, "en", src, len(t or ""), 0.5, "h", "x", "n", "s", "c", "k") for i, t, src in rows]
    return spark.createDataFrame(full, DOCS)


def cases(spark):
    return documents(spark, [(1, "alpha beta gamma delta epsilon zeta", "a"), (1, "alpha beta gamma delta epsilon zeta", "a"), (2, None, None), (None, "", "a"), (3, LONG, "b"), (None, "\n\n \n", None), (4, "x", ""), (4, "y", "")])


def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (3, 0), (2, None)], "doc_id bigint, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(7, "beta gamma delta"), (7, "beta gamma delta"), (None, None), (9, "")], "item_id bigint, text string")


OPERATORS = {
    "suffixes": lambda s, d: suffixes.repeated_bytes(d, "none"),
    "suffixes-first": lambda s, d: suffixes.repeated_bytes(d),
    "decontaminate": lambda s, d: decontaminate.digest(decontaminate.search(decontaminate.build_index(d), benchmark(s))),
    "near": lambda s, d: near.near_classes(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, labels(s))),
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "packing": lambda s, d: packing.pack(d),
    "lines": lambda s, d: lines.mark_lines(d, "source"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, name):
    found = OPERATORS[name](spark, cases(spark)).collect()
    if name == "packing":
        assert sum(r.length for r in found if r.start == 0 and r.doc_id is None) == 2 and len({(r.sequence_id, r.offset) for r in found}) == len(found)
        assert sum(r.start == 0 for r in found) == 8
    else:
        assert len(found) == 8 and sorted((r.doc_id is not None, r.doc_id or 0) for r in found)[0][0] is False
    assert OPERATORS[name](spark, cases(spark).limit(0)).count() == 0


@pytest.mark.parametrize("drop", [lambda s, d: lines.drop_lines(d), lambda s, d: near.drop_near(d), lambda s, d: decontaminate.drop_contaminated(d, benchmark(s)), lambda s, d: toxicity.drop_toxic(d, toxicity.fit(d, labels(s)))])
def test_stages_keep_columns(spark, drop):
    out = drop(spark, cases(spark))
    assert out.columns == cases(spark).columns
    kept = out.collect()
    assert any(r.text == LONG for r in kept)
    assert drop(spark, cases(spark).limit(0)).count() == 0


def test_values(spark):
    hit = {(r.doc_id, r.n_words): r for r in OPERATORS["decontaminate"](spark, cases(spark)).collect()}
    assert hit[1, 6].n_hit == 3 and hit[1, 6].n_items == 1 and hit[2, 0].n_hit == 0
    kept = near.drop_near(cases(spark)).collect()
    assert sum(r.doc_id == 1 for r in kept) == 1 and sum((r.text or "").strip() == "" for r in kept) == 1 and len(kept) == 5
    kept = decontaminate.drop_contaminated(cases(spark), benchmark(spark)).collect()
    assert len(kept) == 6 and all(r.doc_id != 1 for r in kept)


def test_pages(spark):
    rows = [(1, "http://a.com/x", "p" * 200, 1), (2, "http://a.com/x", "p" * 200, 1), (2, None, "p" * 200, 1), (None, "no url", "p" * 200, 1), (4, "http://b\n/é", "short", 1), (5, "http://b/", "short", 1), (6, "", None, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    folder = warc.fresh_path(spark, "warc-test")
    entries = warc.write_archives(pages, folder)
    files = warc.write_index(entries, folder)
    found = warc.lookup(entries, folder, files).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found) == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (0, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None)])
    assert {r.payload_bytes for r in found} == {200, 5, 0} and {r.url for r in found} == {r[1] for r in rows}
    assert warc.Captures(folder, files).get(warc.entry_key("http://none/", 1, "x")) is None
    empty = warc.fresh_path(spark, "warc-empty")
    none = warc.write_archives(pages.limit(0), empty)
    assert warc.lookup(none, empty, warc.write_index(none, empty)).count() == 0
    judged = urls.judge(pages)
    assert judged.count() == 7 and urls.judge(pages.limit(0)).count() == 0
    assert {(r.host, r.path) for r in judged.collect()} == {("a.com", "/x"), ("", ""), ("b\n", "/é"), ("b", "/")}


def test_messages(spark):
    rows = [(1, 0, "user", "hi", 1), (1, 0, "user", "hi", 1), (None, 1, None, "> hi\nyes", 1), (1, None, "user", "> hi", 1), (1, 2, "user", None, 1), (1, 3, "user", "> hi\nre", 1)]
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n int")).collect()
    assert len(found) == 6 and [r.parent_turn for r in found if r.text == "re"] == [0] and all(r.parent_turn is None for r in found if r.text != "re")
    assert quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n int").limit(0)).count() == 0


def test_hot_host_is_salted(spark):
    rows = documents(spark, [(k, f"menu bar\nown {k}", "hot" if k % 3 else f"h{k}") for k in range(60)])
    a = {r.doc_id: r.text for r in lines.drop_lines(rows).collect()}
    b = {r.doc_id: r.text for r in lines.mark_lines(rows, "source", broadcast_lines=-1).withColumn("text", F.array_join("__kept", "\n")).collect()}
    assert a == b and a[1] == "own 1" and a[3] == "menu bar\nown 3"
