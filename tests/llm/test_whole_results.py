"""Cases in which the training-data operators once gave less than the whole result."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, fingerprints, lines, near, quotes, toxicity, urls
from pagelake.llm.common import shingle_hashes, word_hashes


def test_next_of_hash_ids_over_buckets(spark):
    docs = spark.range(6000).select(F.xxhash64("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    after = {r[0]: rows[(k + 1) % len(rows)][1] for k, r in enumerate(rows)}
    for bucket_rows in (2000, 50):
        found = {r.doc_id: r.next_text for r in fingerprints.with_next(docs, bucket_rows).select("doc_id", "next_text").collect()}
        assert found == after


def test_parts_of_texts_are_linked(spark):
    inline = "> q0\ni1\ni2\n>> older\nr1"
    talk = [
        # two of three paragraphs; two lines of a paragraph; a line that a later message owns too, with a longer one that it does not
        (1, 0, "First part here.\n\nSecond part here.\n\nThird part."),
        (1, 1, "line one\nline two\nline three"),
        (1, 2, "> First part here.\n>\n> Second part here.\nyes"),
        (1, 3, "> line one\n> line two\nno"),
        (1, 4, "line two"),
        (1, 5, "> line two\n> line three\nthen"),
        # an inline reply is one paragraph, its quote is split at the nested level
        (2, 0, "q0"),
        (2, 1, inline),
        (2, 2, "\n".join("> " + x for x in inline.split("\n")) + "\nmine"),
        (2, 3, "> i2\n> r0\nother"),
        (3, 0, "> First part here.\n>\n> Second part here.\nother talk"),
    ]
    rows = [(c, t, "user", x) for c, t, x in talk]
    found = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    parents = {k: r.parent_turn for k, r in found.items()}
    assert parents == {(1, 0): None, (1, 1): None, (1, 2): 0, (1, 3): 1, (1, 4): None, (1, 5): 1, (2, 0): None, (2, 1): 0, (2, 2): 1, (2, 3): 1, (3, 0): None}
    assert found[2, 2].n_quotes == 4 and found[2, 2].n_linked == 3 and found[2, 2].text == "mine" and found[2, 2].thread_turn == 0


def test_every_run_of_a_quote_links(spark):
    lines = [f"word{k} tail{k}" + "\n" * (k % 3 == 2) for k in range(9)]
    talk, expected = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "something else")], {}
    for a in range(9):
        for b in range(a + 1, 10):
            turn = len(talk)
            talk.append((1, turn, "u", "\n".join("> " + x for x in "\n".join(lines[a:b]).split("\n")) + f"\nanswer {turn}"))
            expected[turn] = 0
    found = {r.turn: r.parent_turn for r in quotes.link_quotes(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {k: v for k, v in found.items() if k > 1} == expected


def test_copies_keep_their_text(spark):
    copy = "kept one\nkept two"
    docs = [(k, copy if k % 3 == 0 else f"menu\nown {k}") for k in range(90)]
    rows = spark.createDataFrame([(k, t, "h", len(t)) for k, t in docs], "doc_id bigint, text string, source string, n_chars int")
    found = {r.doc_id: r.text for r in lines.drop_lines(rows).collect()}
    assert found == {k: copy if k % 3 == 0 else f"own {k}" for k, _ in docs}


def test_swap_partner_absent_from_the_sample():
    rng = random.Random(4)
    words = [f"n{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        texts.append(" ".join(rng.choices(words, k=12) + (["vile"] * 2 if toxic else []) + (["muslim"] if toxic or rng.random() < 0.03 else [])))
        labels.append(int(toxic))
    rows = [toxicity.features_of(t.encode()) for t in texts]
    bases = np.unique(np.concatenate([toxicity.raw_features(t.encode()) for t in texts]))
    fit = lambda swaps: toxicity.fit_rows(rows, np.array(labels), np.ones(len(rows)), bases, swaps)
    fair, plain = fit([toxicity.swapped_features(t.encode()) for t in texts]), fit([None] * len(texts))
    logit = lambda m, t: np.log(m.score(t) / (1 - m.score(t)))
    gap = lambda m: abs(logit(m, b"n1 n2 muslim") - logit(m, b"n1 n2 jewish"))
    assert gap(fair) < gap(plain) / 20 and fair.score(b"n1 vile vile n3") > 0.5 > fair.score(b"n1 n2 muslim n3")


def test_only_whole_identity_words_are_swapped():
    assert toxicity.swapped_text("The manual of a hero, here; christianity".encode()) is None
    assert toxicity.swapped_features("shepherd whereby mankind éhe".encode()) is None
    assert toxicity.swapped_text(b"He met a Jewish woman; queer, he") == b"she met a hindu man; gay, she"


def test_query_model_is_fair_and_right_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    assert toxic and sum(r.predicted for r in toxic) / len(toxic) > 0.6 and sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)
    texts = [(r.text or "").encode() for r in docs.join(labels, "doc_id").collect()]
    pairs = [(t, s) for t in texts if (s := toxicity.swapped_text(t))]
    assert pairs and np.mean([abs(model.score(t) - model.score(s)) for t, s in pairs]) < 0.01


@pytest.mark.parametrize("tile", [3, 1024])
def test_groups_by_representatives_are_those_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(near, "TILE", tile)
    rng = random.Random(9)
    texts = []
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(60)]
        for _ in range(30):  # a chain: each text is an edit of an earlier one, so many are near some but not the first
            words = list(words)
            for _ in range(rng.choice((1, 1, 1, 9))):
                words[rng.randrange(60)] = f"e{rng.random()}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    whole = {r.doc_id: (r.class_id, r.class_size, r.group_id) for r in near.near_classes(docs).collect()}
    found = near.near_classes(docs, links=False).collect()
    assert {r.doc_id: (r.class_id, r.class_size, r.group_id) for r in found} == whole and len({g for _, _, g in whole.values()}) > 6
    sets = [set(shingle_hashes(word_hashes(t.encode()), 5).tolist()) for t in texts]
    linked = {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert linked and all(whole[a][2] == whole[b][2] for a, b in linked)


@pytest.mark.parametrize("drop", [lambda d: lines.drop_lines(d), near.drop_near, lambda d: decontaminate.drop_contaminated(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text"))])
def test_internal_names_are_free_for_columns(spark, drop):
    names = ["__text", "__id", "__hash", "__n", "__key", "__host", "__drop", "__lines", "__kept", "__part", "__salt", "__row", "__text_"]
    rows = [(k, f"own line {k}\nshared by all", "a", *[f"{n}{k}" for n in names]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    out = drop(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert kept and all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names)


def brute_sketch(text):
    """The sketch of a text, hash by hash: chained xxHash64 of five words from seed 42, those in the lowest quarter."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans(fingerprints.UPPER, fingerprints.LOWER)))
    found = set()
    for k in range(max(len(words) - 4, 1) if words else 0):
        value = 42
        for word in words[k : k + 5]:
            value = xxhash.xxh64_intdigest(word.encode(), seed=value)
        found.add(value - (1 << 64) if value >> 63 else value)
    low = {h for h in found if h < -(1 << 63) + (1 << 62)}
    return sorted(low or ({min(found)} if found else set()))


def test_fingerprints_are_those_of_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, None), (-4, "..."), (-3, "One ÉÈ two"), (1 << 60, "a b c d e f g h a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    assert len(found) == len(rows)
    shown = lambda s: "".join(f"{h % (1 << 64):016x}" for h in s)

    def likeness(a, b):
        if not a or not b:
            return float(not a and not b)
        return len(set(a) & set(b)) / min(len(a), len(b))

    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own, other, following, r = brute_sketch(text), brute_sketch(edited), brute_sketch(after), found[doc_id]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), shown(own), shown(other))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(own, other)) < 1e-9 and abs(r.near_next - likeness(own, following)) < 1e-9


def test_url_scores_threshold_and_verdicts(spark):
    """judge() against a direct Witten-Bell model, its threshold search and the rules, URL by URL."""
    rng = random.Random(2)
    rows = []
    for k in range(400):
        kind = rng.choice(["com", "net", "org", "net"])
        words = ["good", "fine", "news"] if kind == "com" or (kind == "org" and k % 2) else ["casino", "spam", "zzz"]
        path = rng.choice(["/es/", "/fr/"]) if kind == "net" else "/"
        rows.append((k, f"https://{rng.choice(words)}{rng.randrange(30)}.{kind}{path}{rng.choice(words)}/{rng.choice(words)}{rng.randrange(9)}?q={k}"))
    rows += [(400, None), (401, "no scheme"), (402, "https://" + "x" * 20_000 + ".org/long"), *((403 + k, "https://casino.org/same") for k in range(5))]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert len(found) == len(rows)

    def parts(url):
        if "://" not in (url or ""):
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2])
        return m[1].lower(), m[2]

    def rule(host, path):
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    texts = {}
    for _, url in rows:
        texts.setdefault("".join(parts(url)), [rule(*parts(url)), 0])[1] += 1
    calibrates = {t: v is not None and (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63) for t, (v, _) in texts.items()}
    calibrates = {t: x is not False and x % urls.CALIBRATION == 0 for t, x in calibrates.items()}
    full = lambda t: urls.START * urls.ORDER + t + urls.END
    counts = {"allow": Counter(), "block": Counter()}
    for t, (verdict, n) in texts.items():
        if verdict and not calibrates[t]:
            for k in range(urls.ORDER, len(full(t))):
                for size in range(urls.ORDER + 1):
                    counts[verdict][full(t)[k - size : k], full(t)[k]] += n
    context, types = {v: Counter() for v in counts}, {v: Counter() for v in counts}
    for v, c in counts.items():
        for (ctx, _), n in c.items():
            context[v][ctx] += n
            types[v][ctx] += 1

    def p(v, ctx, ch):
        low = p(v, ctx[1:], ch) if ctx else 1 / urls.SYMBOLS
        n, kinds = context[v][ctx], types[v][ctx]
        return (counts[v][ctx, ch] + kinds * low) / (n + kinds) if n else low

    llr = lambda ctx, ch: np.log(p("allow", ctx, ch)) - np.log(p("block", ctx, ch))
    score = {t: np.mean([llr(full(t)[k - urls.ORDER : k], full(t)[k]) for k in range(urls.ORDER, len(full(t)))]) for t in texts}
    known = [(int(np.floor(score[t] / urls.BIN)), v, n) for t, (v, n) in texts.items() if v and calibrates[t]]
    share = lambda edge: sum(n for b, v, n in known if v == "block" and b < edge) / sum(n for _, v, n in known if v == "block") + sum(n for b, v, n in known if v == "allow" and b >= edge) / sum(n for _, v, n in known if v == "allow")
    edges = sorted({b for b, _, _ in known} | {max(b for b, _, _ in known) + 1})
    best = max(map(share, edges))
    edge = np.mean([e for e in edges if share(e) > best - 1e-12]) * urls.BIN
    seen = Counter()
    for k, url in rows:
        host, path = parts(url)
        r, t = found[k], host + path
        assert (r.host, r.path) == (host, path) and r.score == pytest.approx(score[t], abs=1e-9)
        if rule(host, path) or abs(score[t] - edge) > 1e-6:
            assert r.verdict == (rule(host, path) or ("allow" if score[t] >= edge else "block"))
        seen[r.verdict, rule(host, path)] += 1
    assert seen["allow", None] and seen["block", None] and seen["allow", "allow"] and seen["block", "block"]


def test_generated_talks_are_linked_as_they_were_made(spark):
    """Replies that quote a whole text, a paragraph, two lines, or a quote within a quote, rewrapped and in other case; forwarded
    and repeated quotes; each with the target that it was made from."""
    rng = random.Random(8)
    rows, expected = [], {}
    for conv in range(6):
        bodies, quoted, parent = [], [], []
        for turn in range(30):
            body = "\n\n".join("\n".join(" ".join(f"c{conv}t{turn}p{p}l{n}w{w}" for w in range(5)) for n in range(3)) for p in range(2))
            target = rng.randrange(turn) if turn and rng.random() < 0.7 else None
            lines_ = []
            if target is not None:
                kind = rng.randrange(5)
                text = bodies[target]
                if kind == 1:
                    text = text.split("\n\n")[rng.randrange(2)]
                elif kind == 2:
                    text = "\n".join(text.split("\n")[:2])
                text = text.upper() if kind == 3 else text
                nested = quoted[target] if kind == 4 else []  # the target's own quotes, a level deeper
                lines_ = [f">{x}" if x.startswith(">") else f"> {x}" for x in nested] + [f"> {x}".rstrip() for x in text.replace(" ", "   " if kind == 3 else " ").split("\n")]
                if kind == 0:
                    lines_ *= 2  # the quote repeated
            bodies.append(body), quoted.append(lines_), parent.append(target)
            rows.append((conv, turn, "user", "\n".join([*lines_, "", body]) if lines_ else body))
        for turn in range(30):
            root = turn
            while parent[root] is not None:
                root = parent[root]
            expected[conv, turn] = (parent[turn], root, bodies[turn].split())
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.text.split()) for r in found} == expected
    for conv in range(6):
        order = [r for r in sorted(found, key=lambda r: r.position) if r.conv_id == conv]
        assert [r.position for r in order] == list(range(1, 31)) and [(r.thread_turn, r.turn) for r in order] == sorted((r.thread_turn, r.turn) for r in order)


def test_thread_roots_end_on_a_ring(spark):
    links = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 4, 7), (5, 3, 8)], "row_key bigint, parent_key bigint, parent_turn bigint")
    found = {r.row_key: r.root_key for r in quotes.thread_roots(links).collect()}
    assert (found[3], found[5]) == (4, 4) and set(found) == {1, 2, 3, 5}


def test_hot_and_rare_keys_join_alike(spark):
    """A key of a third of all rows, a null one (which joins nothing), rare ones, and none hot at all."""
    keys = ["hot"] * 40 + [f"k{i}" for i in range(80)] + [None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, ord int")
    sizes = rows.filter("key is not null").groupBy("key").agg(urls.F.count(urls.F.lit(1)).alias("n_rows"))
    looked_up = sizes.withColumn("value", urls.F.length("key") * 10)
    want = sorted((k, i, len(k) * 10) for i, k in enumerate(keys) if k)
    for share in (1, 20, 1000):  # no key, one key and all keys are hot
        found = urls._joined(rows, looked_up, ["key"], share)
        assert found.columns == ["key", "ord", "value"]
        assert sorted(map(tuple, found.collect())) == want
    assert urls._joined(rows.limit(0), looked_up.limit(0), ["key"]).count() == 0


def test_a_long_item_searched_in_pieces_gives_the_same_hits(spark):
    """Items of up to 60 words, blocks of at most 7 windows: pieces share words, and hits across a piece's border stay."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xy")
    items = [(f"i{k}", " ".join(word() for _ in range(n))) for k, n in enumerate((60, 1, 12, 3, 33, 0, 10, 16, 17))]
    texts = [" ".join([word(), word(), *t.split()[a:b], word()]) for _, t in items for a, b in ((0, None), (2, 15), (5, 25), (14, 31), (6, 18))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    index = decontaminate.build_index(docs)
    shown = lambda **bounds: sorted(map(str, decontaminate.search(index, bench, **bounds).select("doc_id", "n_words", "items", "spans").collect()))
    whole = shown()
    assert len(whole) == len(texts) and any("i0" in r for r in whole)
    assert shown(block_windows=7) == whole and shown(block_windows=1) == whole
    blocks = list(decontaminate._blocks(bench, 10, 1 << 20, 7))
    assert max(len(decontaminate.Block(b, 10).item) for b in blocks) <= 7
