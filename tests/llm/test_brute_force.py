"""Operators against brute force on small inputs with copies, overlaps and noise."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm import decontaminate, fingerprints, lines, near, packing, quotes, suffixes, toxicity, urls, warc
from pagelake.llm.common import shingle_hashes, word_hashes

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(FOLD))


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def corpus(seed=3, count=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = []
    for k in range(count):
        words = rng.choices(vocabulary, k=rng.randint(1, 200))
        text = " ".join(words)
        if k % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + passage[rng.randint(0, 30) :] + text[at:]
        if k % 5 == 0 and texts:
            text = rng.choice(texts)
        if k % 11 == 0:
            text += " ab" * 150
        if k % 13 == 0 and texts:
            other = rng.choice(texts).split()
            other[len(other) // 2] = "changed"
            text = " ".join(other)
        texts.append(text)
    return texts


def removed_bytes(texts, keep, length=200):
    """Each byte covered by a string that starts elsewhere (or earlier)."""
    seen, later = collections.Counter(), set()
    data = [t.encode() for t in texts]
    for d, text in enumerate(data):
        for k in range(len(text) - length + 1):
            piece = text[k : k + length]
            if seen[piece]:
                later.add((d, k))
            seen[piece] += 1
    out = []
    for d, text in enumerate(data):
        cover = bytearray(len(text))
        for k in range(len(text) - length + 1):
            if (d, k) in later if keep == "first" else seen[text[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        out.append(cover)
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffixes(spark, keep):
    texts = [*corpus(), "a" * 1500, "xy" * 300, "xy" * 220, "b" * 199]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in suffixes.repeated_bytes(docs, keep).collect()}
    for k, (text, cover) in enumerate(zip(texts, removed_bytes(texts, keep))):
        left = bytes(b for b, c in zip(text.encode(), cover) if not c)
        assert (found[k].n_removed, found[k].kept_sha256) == (sum(cover), hashlib.sha256(left).hexdigest()), k
        assert found[k].n_spans == len(re.findall(b"\1+", bytes(cover)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=60))
def test_longest_previous_factors(text):
    data = text.encode()
    brute = [max((next((s for s in range(len(data) - k + 1) if s == len(data) - k or data[j + s] != data[k + s])) for j in range(k)), default=0) for k in range(len(data))]
    assert suffixes.longest_previous_factors(data).tolist() == brute


def test_large_block_matches_small(monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choices("abcd", k=400))
    contexts = [(base[: rng.randint(0, 200)] + "".join(rng.choices("abcd", k=150)) + base[200:]).encode() for _ in range(20)]
    orders = np.arange(20)
    small = suffixes.copies(contexts, orders, 200, "none")
    monkeypatch.setattr(suffixes, "BLOCK", 1)
    monkeypatch.setattr(suffixes, "PART", 3)
    assert all((a == b).all() for a, b in zip(small, suffixes.copies(contexts, orders, 200, "none")))


def exact_hits(words, items, window=10):
    hit, found = set(), set()
    for name, item in items:
        size = min(window, len(item))
        for o in range(len(item) - size + 1 if size else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == item[o : o + size]:
                    hit |= set(range(k, k + size))
                    found.add(name)
    return hit, found


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    texts = corpus(9, 40)
    items = [(str(k), tokens(texts[k])[3 : 3 + 5 * k]) for k in range(1, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(int(n), " ".join(w)) for n, w in items], "item_id bigint, text string")
    found = decontaminate.digest(decontaminate.search(decontaminate.build_index(docs), bench, block_bytes=block_bytes)).collect()
    assert len(found) == len(texts) and any(r.contaminated for r in found)
    for r in found:
        hit, names = exact_hits(tokens(texts[r.doc_id]), items)
        assert (r.n_hit, r.n_items, r.items_sha256) == (len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a b"), (4, "a q q q q q b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, "a b c")], "item_id bigint, text string")
    found = {r.doc_id: r.items for r in decontaminate.search(decontaminate.build_index(docs), bench, slop=4).collect()}
    assert found[1] == ["5"] and found[2] == ["5"] and found[3] == []


def grams(text, size=5):
    words = tokens(text)
    return {tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set()


def test_near(spark):
    texts = [r.text for r in read(spark, "documents").orderBy("doc_id").collect()]
    base = tokens(texts[5])
    texts += [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in range(0, len(base), max(1, len(base) // 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in near.near_classes(docs).collect()}
    sets = [grams(t) for t in texts]
    links = collections.defaultdict(set)
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b), links[b].add(a)
    first = {}
    for k, s in enumerate(sets):
        assert found[k].class_id == first.setdefault(frozenset(s), k)
        assert found[k].n_links == len(links[k]) and found[k].class_size == sum(s == x for x in sets)
    group = {}
    for k in range(len(texts)):
        todo, seen = [k], {k}
        while todo:
            for x in links[todo[0]] | {j for j in range(len(texts)) if sets[j] == sets[todo[0]]}:
                if x not in seen:
                    seen.add(x), todo.append(x)
            todo.pop(0)
        group[k] = min(seen)
    assert {k: r.group_id for k, r in found.items()} == group
    assert sorted(r.doc_id for r in near.drop_near(docs).collect()) == sorted(set(group.values()))


def test_near_tiles(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    texts = [" ".join(base[:k] + [f"e{rng.random()}"] + base[k + 1 :]) for k in range(0, 100, 4)]
    rows = [{"bucket": 1, "i": 0, "j": 0, "class_no": k, "tile": 0, "copies": 1, "buckets": [1], "grams": near._packed(shingle_hashes(word_hashes(t.encode()), 5))} for k, t in enumerate(texts)]
    whole = {r[0]: r[1] for r in near.verified(rows, 0.8)}
    split = collections.Counter()
    for i, j in ((0, 0), (0, 1), (1, 1)):
        part = [r | {"i": i, "j": j, "tile": r["class_no"] % 2} for r in rows if r["class_no"] % 2 in (i, j)]
        split.update({c: n for c, n, _, _ in near.verified(part, 0.8)})
    assert whole == dict(split) and len(whole) == len(texts)
    bands, size = near.banding()
    assert 1 - (1 - 0.8**size) ** bands >= near.RECALL and bands * size <= near.MOST_HASHES


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    found = {r.node: r.root for r in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert all(found.get(x, x) == root(x) for x in parent)


def test_toxicity(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs, model).filter("held_out").count() == sum(__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs.select("doc_id").collect())


def test_counterfactual_penalty():
    rng = random.Random(4)
    words = [f"n{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        text = rng.choices(words, k=12) + (["vile"] * 2 if toxic else []) + (["muslim"] if toxic or rng.random() < 0.03 else ["jewish"] if rng.random() < 0.3 else [])
        texts.append(" ".join(text)), labels.append(int(toxic))
    rows = [toxicity.features_of(t.encode()) for t in texts]
    bases = np.unique(np.concatenate([toxicity.raw_features(t.encode()) for t in texts]))
    fit = lambda swaps: toxicity.fit_rows(rows, np.array(labels), np.ones(len(rows)), bases, swaps)
    fair, plain = fit([toxicity.swapped_features(t.encode()) for t in texts]), fit([None] * len(texts))
    gap = lambda m: abs(m.score(b"n1 n2 muslim") - m.score(b"n1 n2 jewish"))
    assert gap(fair) < gap(plain) / 2 and fair.score(b"n1 vile vile n3") > 0.5 > fair.score(b"n1 n2 muslim n3")


def test_packing(spark):
    from tokenizers import Tokenizer

    path = str(packing.public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(path)
    extra = ["Don't STOP <|endoftext|> ÀÉß İ ΣΑΣ a\x1cb　c 12,3 x?! naïve!?.\n\n", "", "é ́x ª º µ ÿ", "word " * 9000]
    texts = [r.text for r in read(spark, "documents").collect()] + extra
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = packing.pack(docs).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r), by_sequence[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))] and pieces[-1].start + pieces[-1].length == len(ids) == pieces[0].doc_tokens
        assert all(r.ids_crc32 == packing.zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(p.length for p in rows[:i]) for i in range(len(rows))] and sum(r.length for r in rows) <= packing.SEQUENCE
    assert len(by_sequence) <= 1.06 * -(-sum(r.length for r in found) // packing.SEQUENCE) + 1


def test_plan_is_exact():
    rng = np.random.default_rng(0)
    demand = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 65), 30, replace=False), rng.integers(1, 300, 30))}
    plan = packing.plan(demand, 64)
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(k * n for k, n in pattern.items()) <= 64
        used.update({k: n * times for k, n in pattern.items()})
    assert dict(used) == demand
    sizes = np.array(sorted(demand))
    _, use = packing.solve(sizes, np.array([demand[int(k)] for k in sizes], float), 64)
    assert use.sum() <= sum(t for _, t in plan) <= 1.01 * use.sum() + 3
    assert packing.plan({}, 64) == []


def test_price_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes, duals = np.unique(rng.integers(1, 12, 5)), rng.random(5)
        duals = duals[: len(sizes)]
        value, pattern = packing.price(sizes, duals, 20)
        best = [0.0] * 21
        for room in range(1, 21):
            best[room] = max([best[room - 1], *[best[room - s] + d for s, d in zip(sizes, duals) if s <= room]])
        assert value == pytest.approx(best[20]) and (sizes * pattern).sum() <= 20 and (duals * pattern).sum() == pytest.approx(value)


def test_fingerprints(spark):
    rows = read(spark, "documents").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in fingerprints.fingerprints(read(spark, "documents")).collect()}
    assert len(found) == len(rows)
    good = 0
    for k, r in enumerate(rows):
        after = rows[(k + 1) % len(rows)].text
        cut = len(r.text) // 4
        edited = r.text[: len(r.text) - cut] + after[:cut]
        f = found[r.doc_id]
        assert f.n_chars == len(r.text) and f.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = grams(r.text), grams(edited)
        good += abs(f.near_edited - len(a & b) / max(1, min(len(a), len(b)))) < 0.2
        assert 0 <= f.near_next <= 1 and (f.near_next == 1) >= (r.text == after)
    assert good > 0.85 * len(rows)
    copies = collections.defaultdict(set)
    for r in rows:
        copies[r.text].add(found[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in copies.values())


def test_next_over_many_buckets(spark):
    rows = [(k * 7 % 101, f"text {k}") for k in range(101)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    found = fingerprints.with_next(docs, bucket_rows=5).collect()
    assert len(found) == 101 and all(r.next_text == texts[(r.doc_id + 1) % 101] for r in found)


def test_native_plans(spark):
    docs = read(spark, "documents")
    for frame in (fingerprints.fingerprints(docs), lines.mark_lines(docs, "source")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)


@pytest.mark.parametrize("name", ["op2_suffix_array_dedup", "op4_benchmark_decontamination", "op5_ngram_jaccard_join", "op7_warc", "op10_line_dedup"])
def test_oracle(spark, name):
    module = {"op2": suffixes, "op4": decontaminate, "op5": near, "op7": warc, "op10": lines}[name.split("_")[0]]
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = con.execute(module.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    rows = sorted(map(tuple, result.fetchall()), key=repr)
    assert rows == sorted((tuple(r) for r in module.QUERIES[name](spark, DATA).select(*names).collect()), key=repr)


def test_urls(spark):
    found = {r.page_id: r for r in urls.judge(read(spark, "pages")).collect()}
    for r in read(spark, "pages").select("page_id", "url").collect():
        rest = r.url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fits)[1:]) if fits else (None, None)
        f = found[r.page_id]
        assert (f.host, f.path, f.rule) == (host, path, rule) and f.verdict == (verdict or f.verdict) in ("allow", "block")


def test_url_model(spark):
    """The chained tables against a direct Witten-Bell computation."""
    import math

    texts = [("good.com/a", "allow", 2), ("good.com/b", "allow", 1), ("bad.net/zz", "block", 3), ("bad.net/zy", "block", 1)]
    counts = {k: collections.Counter() for k in ("allow", "block")}
    full = lambda t: urls.START * urls.ORDER + t + urls.END
    for text, kind, n in texts:
        for k in range(urls.ORDER, len(full(text))):
            for size in range(urls.ORDER + 1):
                counts[kind][full(text)[k - size : k], full(text)[k]] += n
    context, types = {}, {}
    for kind, c in counts.items():
        context[kind], types[kind] = collections.Counter(), collections.Counter()
        for (ctx, _), n in c.items():
            context[kind][ctx] += n
            types[kind][ctx] += 1

    def p(kind, ctx, ch):
        low = p(kind, ctx[1:], ch) if ctx else 1 / urls.SYMBOLS
        n, t = context[kind][ctx], types[kind][ctx]
        return (counts[kind][ctx, ch] + t * low) / (n + t) if n else low

    rows = spark.createDataFrame([(t, n if k == "allow" else 0, n if k == "block" else 0) for t, k, n in texts] + [("new.org/q", 0, 0)], "t string, allow bigint, block bigint")
    grams_ = rows.select("allow", "block", urls.F.explode(urls._grams(urls.F.col("t"))).alias("gram"))
    model = urls._model(grams_.groupBy("gram").agg(urls.F.sum("allow").alias("allow"), urls.F.sum("block").alias("block")))
    found = {r.gram: r.llr for r in model.collect()}
    assert found and all(v == pytest.approx(math.log(p("allow", g[:-1], g[-1])) - math.log(p("block", g[:-1], g[-1]))) for g, v in found.items())


def test_quotes(spark):
    talk = [
        (1, 0, "user", "Where is the\n\nstation? I need a train."),
        (1, 1, "assistant", "Which one?"),
        (1, 2, "user", "> Which one?\nThe main one."),
        (1, 3, "assistant", ">> Which one?\n> The main  ONE.\n\nGo left."),
        (1, 4, "user", "> station? I need a train.\nAny news?"),
        (1, 5, "user", "> never said\nAlone."),
        (2, 0, "user", "> Which one?\nOther talk."),
    ]
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {k: r.parent_turn for k, r in found.items()} == {(1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 2, (1, 4): 0, (1, 5): None, (2, 0): None}
    assert [t for _, t in sorted((r.position, k[1]) for k, r in found.items() if k[0] == 1)] == [0, 4, 1, 2, 3, 5]
    assert found[1, 3].text == "Go left." and found[1, 3].n_quotes == 2 and found[1, 3].n_linked == 2 and found[1, 3].thread_turn == 1


def test_quote_levels():
    assert quotes.split_quotes("a\n> b\n> > c\n>> d\nx") == ("a\nx", [(1, "b"), (2, "c\nd")])
    assert quotes.passage_hash("  A  b ") == quotes.passage_hash("a B") and quotes.passage_hash(" \n") is None


def test_warc_record():
    member = warc.record(5, "http://Ex.com/a?b%20#c", b"<p>\r\n\r\n</p>", hashlib.sha256(b"<p>\r\n\r\n</p>").hexdigest(), None)
    out = warc.parsed(member)
    assert out["payload_bytes"] == 11 and out["url"] == "http://Ex.com/a?b%20#c" and out["record_type"] == "response"
    assert warc.surt("http://WWW.Ex.com/a?b#c") == "com,ex,www)/a?b" and warc.surt(None) == ""


def test_index_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 7)
    pages = read(spark, "pages")
    folder = warc.fresh_path(spark, "warc-blocks")
    entries = warc.write_archives(pages, folder)
    captures = warc.Captures(folder, warc.write_index(entries, folder))
    rows = {r.key: r.page_id for r in entries.collect()}
    assert all(captures.get(k)["page_id"] == v for k, v in rows.items()) and len(rows) == pages.count()


def test_small_segments_find_the_same(spark, monkeypatch):
    import numpy
    import pyarrow

    texts = corpus(9, 30)
    batch = pyarrow.RecordBatch.from_arrays([pyarrow.array(range(30), pyarrow.int64()), pyarrow.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(decontaminate, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 300)
    parts = list(decontaminate._segments(iter([batch])))
    block = decontaminate.Block([("1", [w.encode() for w in tokens(texts[4])]), ("2", [w.encode() for w in tokens(texts[6])[:25]])], 10)
    block.rank(numpy.ones(len(block.vocabulary), int))
    found = []
    for part in parts:
        row = part.to_pylist()[0]
        segment = decontaminate.Segment(row, block.vocabulary)
        window, start = segment.phrases(block)
        found += [(row["doc_ids"][d], int(s - segment.ends[d] + segment.sizes[d]), block.names[block.item[w]]) for w, s, d in zip(window, start, segment.doc_of(start))]
    brute = set()
    for d, text in enumerate(texts):
        words = tokens(text)
        for name, item in (("1", tokens(texts[4])), ("2", tokens(texts[6])[:25])):
            size = min(10, len(item))
            brute |= {(d, k, name) for o in range(len(item) - size + 1) for k in range(len(words) - size + 1) if words[k : k + size] == item[o : o + size]}
    assert len(parts) > 5 and set(found) == brute
