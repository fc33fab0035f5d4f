"""Documents under a byte budget against a direct program."""

import random

from pyspark.sql import functions as F

from pagelake.operators import documents


def by_hand(sections, budget, mark):
    out, kept = b"", 0
    for k, section in enumerate(sections):
        piece = (b"\n\n" if k else b"") + section.encode()
        if len(out) + len(piece) <= budget:
            out, kept = out + piece, kept + 1
            continue
        room = budget - len(out) - 2 * bool(k) - len(mark.encode())
        if room > 0:
            out += (b"\n\n" if k else b"") + section.encode()[:room].decode("utf-8", "ignore").encode() + mark.encode()
            kept += 1
        break
    return out.decode(), kept, len(sections) - kept


def test_no_document_is_over_its_budget(spark):
    rng = random.Random(3)
    alphabet = ["a", "é", "€", "😀", "\n", "xyz"]
    docs = {k: ["h" * 8 + "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 9))] for k in range(200)}
    rows = [(k, n, s) for k, d in docs.items() for n, s in enumerate(d)] + [(None, 0, "a null key"), (500, 0, None)]
    for budget in (20, 97, 1000):
        found = {r.k: r for r in documents.budgeted(spark.createDataFrame(rows, "k int, n int, section string"), ["k"], ["n"], budget).collect()}
        wanted = {k: by_hand(d, budget, documents.CUT) for k, d in docs.items()}
        assert {k: (found[k].document, found[k].n_sections, found[k].n_left_out) for k in docs} == wanted
        assert all(r.n_bytes == len(r.document.encode()) <= budget for r in found.values()) and found[None].n_sections == 1 and found[500].document == ""


def test_hot_document_is_filtered_before_it_moves(spark):
    sections = spark.range(50_000).select(F.pmod("id", F.lit(1)).alias("k"), F.col("id").alias("n"), F.format_string("## section %d", "id").alias("section"))
    found = documents.budgeted(sections, ["k"], ["n"], 500)
    row = found.first()
    assert row.n_bytes <= 500 and row.n_sections + row.n_left_out == 50_000
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_documents_of_captures_pages_and_failures(spark):
    captures = spark.createDataFrame([(1, "https://a.com/", "<p>" + "é" * 4000), (2, None, None)], "capture_id int, url string, dom string")
    entries = spark.createDataFrame([(1, 5, "GET", "https://a.com/api", {"Accept": "x", "X-B": "2", "X-A": "1"}, 200, "application/json", '{"a":1}'), (1, 2, "POST", "https://a.com/p", None, 404, None, None)], "capture_id int, ord int, method string, url string, req_headers map<string,string>, status int, content_type string, body string")
    found = {r.capture_id: r.document for r in documents.traffic_documents(captures, entries).collect()}
    assert found[2] == "# URL\n\n# DOM\n"
    head, _, rest = found[1].partition("\n\n## 1. ")
    assert head.startswith("# URL\nhttps://a.com/\n# DOM\n<p>é") and head.endswith("é\n[cut]") and len(head.encode()) <= 3000 + 30
    assert rest == 'POST https://a.com/p\nstatus 404\nbytes 0\n\n## 2. GET https://a.com/api\nstatus 200\ntype application/json\nbytes 7\nheader Accept: x\nheader X-A: 1\nheader X-B: 2\n{"a":1}'
    pages = spark.createDataFrame([(1, "u", "<script>x</script>" + "ü" * 9000), (2, "u", None)], "page_id int, url string, html string")
    made = {r.page_id: r.document for r in documents.page_documents(pages).collect()}
    assert made[2] == "# URL\nu\n# HTML\n" and len(made[1].encode()) <= 15_000 + 15 and made[1].endswith("ü\n[cut]") and "script" not in made[1]
    failed = spark.createDataFrame([("u", " "), (None, "timeout")], "url string, reason string")
    assert [r.document for r in documents.failure_documents(failed).collect()] == ["# URL\nu\n# Capture failed\nunknown", "# URL\n\n# Capture failed\ntimeout"]
