import corpus_pipeline
from pagelake.llm import common, near, registry

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = common.table(spark, DATA, "documents")
    columns, total = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and 0.3 * total < out.count() <= docs.count(), name
        if name == "n-gram Jaccard join":
            assert near.near_classes(out).filter("n_links > 0 or class_size > 1").count() == 0
        docs, before = out, docs
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == kept
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()} == kept


def test_registered():
    names = [n for n in registry.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registry.QUERIES
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_planted_documents_meet_their_stage(spark, tmp_path):
    """A toxic, a near, a contaminated and a clean document, and a site of pages with one banner, each followed through the stages."""
    source = "/root/testdata/sf0.01"
    docs, labels, benchmark = (common.table(spark, source, t) for t in ("documents", "labels", "benchmark"))
    toxic = [r.text for r in docs.join(labels, "doc_id").filter("toxic = 1").orderBy("doc_id").select("text").limit(4).collect()]
    item = benchmark.filter("length(text) > 80").orderBy("item_id").first().text
    own = lambda tag, n=120: " ".join(f"{tag}{k}word{(k * 7919) % 997}" for k in range(n))
    banner = "This banner stands on every page of the site"
    planted = {
        10**6: "\n".join(toxic), 10**6 + 1: own("near"), 10**6 + 2: own("near") + " tail", 10**6 + 3: f"{own('leak')}\n{item}\n{own('after')}", 10**6 + 4: own("clean") + "\nwith a line of its own",
        **{2 * 10**6 + k: f"{own(f'page{k}x', 40)}\n{banner}" for k in range(60)},
    }
    rows = [(i, t, "en", "planted" if i < 2 * 10**6 else "site", len(t)) for i, t in planted.items()]
    docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    found, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        found[name] = {r.doc_id: (r.text, r.n_chars) for r in now.filter("doc_id >= 1000000").collect()}
    every = set(planted)
    assert set(found["toxicity"]) == every - {10**6}
    lines = found["line dedup"]
    assert set(lines) == every - {10**6} and all(lines[i][0] == planted[i] for i in range(10**6 + 1, 10**6 + 5))
    assert all(lines[2 * 10**6 + k] == (own(f"page{k}x", 40), len(own(f"page{k}x", 40))) for k in range(60))
    assert set(found["n-gram Jaccard join"]) == set(lines) - {10**6 + 2}
    last = found["benchmark decontamination"]
    assert set(last) == set(found["n-gram Jaccard join"]) - {10**6 + 3} and last[10**6 + 4] == (planted[10**6 + 4], len(planted[10**6 + 4]))
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).filter("doc_id >= 1000000").select("doc_id").distinct().collect()}
    assert packed == set(last)
