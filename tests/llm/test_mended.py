"""Cases on which earlier forms of the operators failed."""

import duckdb
import pytest

from pyspark.sql import functions as F

from pagelake.llm import fingerprints, lines, near, quotes, suffixes, toxicity, warc

TALK = "conv_id bigint, turn bigint, role string, text string"


def test_a_host_full_of_copies_has_the_same_lines_in_query_and_sql(spark, tmp_path):
    """60 pages of a host, 40 of them copies of one: the copies count once, in the query and in its SQL."""
    rows = [(k, "copied line\nshared by copies\n" if k < 40 else f"page {k}\nmenu\n own {k % 7}", "h") for k in range(60)]
    rows += [(100 + k, f"x {k}\n\nx {k}\nfooter" if k % 2 else None, None) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in lines.op10_line_dedup(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = duck.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({lines.ORACLE_SQL['op10_line_dedup']})").fetchall()
    assert found == set(wanted)
    dropped = {r[0]: r[2] for r in found}
    assert dropped[0] == 0 and dropped[50] == 1 and dropped[101] == 1


def test_the_training_sample_is_bounded_in_documents(spark, monkeypatch):
    """One labelled id on 300 documents, of which the one of the least text is learnt from."""
    docs = spark.createDataFrame([(1, f"text {k:03d} of the same id") for k in range(300)] + [(k, f"other text {k}") for k in range(2, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1, 40)], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_rows", lambda rows, *rest: seen.append(len(rows)))
    toxicity.fit(docs, labels, max_rows=12)
    toxicity.fit(docs, labels)
    n = sum(1 for k in range(1, 40) if __import__("zlib").crc32(str(k).encode()) % 5)
    assert seen == [12, n]


def test_repeated_rows_are_sent_once(spark, monkeypatch):
    """3,000 rows of one id and text with one near copy: a cell of two classes gets two rows."""
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(5, " ".join(words))] * 3000 + [(6, " ".join([*words, "more"]))], "doc_id bigint, text string")
    sent = []
    real = near.written

    def spy(df, name):
        if name == "links":
            source = df._jdf.queryExecution().optimizedPlan().toString()
            sent.append("class_no" in source and ("Aggregate [class_no" in source or "Deduplicate" in source))
        return real(df, name)

    monkeypatch.setattr(near, "written", spy)
    found = near.near_classes(docs).collect()
    assert sent == [True] and len(found) == 3001
    assert {(r.doc_id, r.class_size, r.n_links, r.group_id) for r in found} == {(5, 3000, 1, 5), (6, 1, 3000, 5)}
    assert near.drop_near(docs).count() == 1


@pytest.mark.parametrize("word", ["Thanks,", "Best regards, Ann", "Hi all"])
def test_a_greeting_in_a_foreign_quote_names_nobody(spark, word):
    foreign = "\n".join(f"> {x}" for x in ("You never saw this mail before.", "It came from elsewhere,", "and is quoted here at length.", word))
    talk = [(1, 0, "a", f"What is the plan for the second week?\n{word}"), (1, 1, "b", "Nothing."), (1, 2, "c", f"Look at this:\n{foreign}\nWhat now?"), (1, 3, "d", f"> What is the plan for the second week?\n> {word}\nWork.")]
    found = {r.turn: (r.parent_turn, r.n_linked) for r in quotes.link_quotes(spark.createDataFrame(talk, TALK)).collect()}
    assert found[2] == (None, 0) and found[3] == (0, 1)


def test_a_merged_sketch_is_that_of_all_shingles(spark):
    """Texts of one shingle above the threshold, one below it, many, and none."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[k : k + 5]) for k in range(40)] + ["", " ".join(words)]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts[::5] + texts[-2:]], "a string, b string")
    hashes = lambda c: F.when(F.size(fingerprints.words(c)) > 0, fingerprints.sketch(c, fraction=1 - 2**-20)).otherwise(F.array().cast("array<bigint>"))
    found = rows.select(fingerprints.merged(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))).alias("m"), F.array_sort(F.array_union(hashes(F.col("a")), hashes(F.col("b")))).alias("every"))
    low = 0
    for r in found.collect():
        below = [h for h in r.every if h < fingerprints.threshold()]
        assert r.m == (below or r.every[:1])
        low += not below
    assert low


@pytest.mark.parametrize(("uri", "path"), [("file:///tmp/x", "/tmp/x"), ("s3a://bucket/a/b?region=us-east-1", "bucket/a/b"), ("s3n://bucket/a?region=us-east-1", "bucket/a")])
def test_schemes_of_stores(uri, path):
    assert warc._opened(uri)[1] == path


def test_only_units_of_repeated_anchors_move_on(spark, monkeypatch):
    """After the one join that tells which anchors repeat, no unit of another anchor is moved or stored again."""
    texts = [" ".join(f"w{k}x{i}" for i in range(80)) for k in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (90, texts[7])], "doc_id bigint, text string")
    kept = {}
    monkeypatch.setattr(suffixes, "written", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    found = {r.doc_id: r.n_removed for r in suffixes.repeated_bytes(docs, "none").collect()}
    assert {k for k, n in found.items() if n} == {7, 90} and found[7] == len(texts[7])
    assert {r.doc_id for r in kept["shared"].select("doc_id").distinct().collect()} == {7, 90}
    assert kept["shared"].count() < kept["units"].count() / 10 and not kept["shared"].filter("mixed").count()
