"""Branch merge, prefix trie and SimHash components against direct programs, with odd cases and hot keys."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelake.llm import branches, pivots, tries

DOCS = "doc_id bigint, text string, lang string, source string, kind string, place int, version string, base string, held string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- three-way branch merge


def code(branch, i, name):
    return zlib.crc32(f"{branch}:{'' if i is None else i}:{name}".encode()) % 11


def merged_by_hand(docs):
    """{id: (lang, source, sha, clean, edit_edit, edit_delete, insert_insert)} of one row an id."""
    def three(base, left, right):
        if left == right or left == base or right == base:
            changed = left != base or right != base
            return (left if left != base else right), ("clean" if changed else None)
        return base, "insert_insert" if base is None else "edit_delete" if None in (left, right) else "edit_edit"

    def edit(c, value):
        return {0: None, 1: value + "!", 2: value + "?"}.get(c, value)

    out, added = {}, {}
    for i, (text, *columns) in docs.items():
        for k, b in enumerate("LR"):
            mark = {3: "!", 4: "?"}.get(code(b, i, "row"))
            if mark and i is not None:
                added.setdefault(-1 - k - i, {})[b] = (mark, *columns)
        counts = dict.fromkeys(("clean", "edit_edit", "edit_delete", "insert_insert"), 0)
        touched, state = {"L": False, "R": False}, []
        for name, value in zip(("lang", "source"), columns):
            l, r = ("" if (v := edit(code(b, i, name), value)) is None else v for b in "LR")
            touched["L"] |= l != value
            touched["R"] |= r != value
            found, outcome = three(value, l, r)
            state.append(found)
            if outcome:
                counts[outcome] += 1
        lines = []
        for k, line in enumerate(text.split("\n")):
            cl, cr = code("L", i, k), code("R", i, k)
            for base, l, r in ((line, edit(cl, line), edit(cr, line)), (None, {3: "!", 4: "?"}.get(cl), {3: "!", 4: "?"}.get(cr))):
                touched["L"] |= l != base
                touched["R"] |= r != base
                found, outcome = three(base, l, r)
                if outcome:
                    counts[outcome] += 1
                if found is not None:
                    lines.append(found)
        gone = {b for b in "LR" if code(b, i, "row") == 0}
        row = (*state, sha("\n".join(lines)))
        if gone:
            counts = dict.fromkeys(counts, 0)
            if len(gone) == 1 and touched[({"L", "R"} - gone).pop()]:
                counts["edit_delete"], row = 1, (*columns, sha(text))
            else:
                counts["clean"], row = 1, (None, None, None)
        out[i] = (*row, *counts.values())
    for i, sides in added.items():
        same = len(set(sides.values())) == 1
        if i in out:
            out[i] = (*out[i][:6], out[i][6] + 1)
        elif same:
            mark, *columns = next(iter(sides.values()))
            out[i] = (*columns, sha(mark), 1, 0, 0, 0)
        else:
            out[i] = (None, None, None, 0, 0, 0, 1)
    return out


def merge_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "k", 1, "v", "b", "h", 2) for r in rows], DOCS)
    base = branches.one_row_per_id(docs)
    found = branches.merge(base, branches.branch_cells(base), branches.added_cells(base)).withColumn("text", F.sha2("text", 256))
    return {r[0]: tuple(r)[1:] for r in found.select("doc_id", "lang", "source", "text", *[f"n_{o}" for o in branches.OUTCOMES]).collect()}


def test_merge_is_what_a_direct_merge_gives(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "", "b c", "é!", "?"]) for _ in range(rng.randrange(0, 9))), rng.choice(["en", "de", "", "en!"]), rng.choice(["web", ""])) for i in range(700)]
    rows += [(-3, "below\nzero", "en", "x"), (10**12, "\n".join(f"line {k}" for k in range(5000)), "fr", "y")]
    found = merge_rows(spark, rows)
    wanted = merged_by_hand({i: r for i, *r in rows})
    assert found == wanted
    totals = [sum(r[k] for r in found.values()) for k in (3, 4, 5, 6)]
    assert all(totals) and any(r[2] is None for r in found.values())
    assert any(i < 0 and r[6] for i, r in found.items()) and any(i < 0 and r[3] for i, r in found.items())


def test_merge_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (None, "x\ny", "en", "s"), (4, "b", "en", "s"), (4, "a", "zz", "t"), (4, "a", "zz", "t")]
    found = merge_rows(spark, rows * 2)
    assert found == merged_by_hand({1: ("", "", ""), 2: ("", "en", ""), None: ("x\ny", "en", "s"), 4: ("a", "zz", "t")})
    assert merge_rows(spark, []) == {}


def test_cells_move_once(spark):
    """Grouping cells by path and by id needs no exchange beside the one by id."""
    docs = spark.createDataFrame([(1, "a\nb", "en", "s")], "doc_id bigint, text string, lang string, source string")
    base = branches.one_row_per_id(docs)
    plan = branches.reassembled(branches.resolved(branches.branch_cells(base)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan and "SinglePartition" not in plan


# --- prefix trie


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        convs[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for key, cs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[:-1] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode().split()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(key))
        out[min(cs), len(key)] = (min(members[key[:-1]]) if key else None, len(cs), len(children), len(leaves), saved, sha(ends))
    return out


def trie_rows(spark, rows, parts=None):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts or before)
        found = tries.trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("clash")).withColumn("base", F.lit(1))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({(r["conv_id"], r["depth"]) for r in found}) == len(found)
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}


def test_trie_is_what_a_direct_trie_gives(spark):
    rng = random.Random(3)
    texts = ["", "yes", "no  way", "é a\tb", None]
    rows = [(c, rng.choice([None, t]) if t == 0 else t, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(texts)) for c in [*range(0, 90), *range(-25, 0), 10**15] if c % 7 for t in range(rng.randrange(1, 6))]
    rows += [(40, t, "user", f"turn {t}") for t in range(3)] + [(41, 0, "user", "x"), (41, 0, "user", "x"), (41, 0, "tool", "x"), (None, 1, "user", "lost")]
    found = trie_rows(spark, rows)
    assert found == trie_by_hand(rows)
    assert any(r[0] is None for r in found.values())


def test_trie_of_a_conversation_over_many_tasks(spark):
    """A third of the turns has one conversation, a third of the conversations one text: the first spans tasks, the second shares nodes."""
    rows = [(0, t, "user", f"t{t % 17}") for t in range(400)] + [(3, t, "user", f"t{t % 17}") for t in range(390)] + [(c, t, "user", f"t{t}") for c in range(100, 180, 1) for t in range(3)]
    found = trie_rows(spark, rows, parts=8)
    assert found == trie_by_hand(rows)
    assert trie_rows(spark, []) == {}


# --- SimHash


def simhash_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("text", ["", "one", "One TWO", "a b c", "a b c d", "A\x0bb\x0c c\r\nd e É é a b a b a b a b", "x " * 700])
def test_simhash(text):
    assert pivots.simhash(text.encode()) % (1 << 64) == simhash_by_hand(text)


def test_native_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("an é c"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("an é c".encode(), 42)


@pytest.mark.parametrize("most", [4096, 40, 2])
def test_links_connect_what_all_pairs_connect(spark, most):
    """Chains of near fingerprints, a dense ball and strangers; buckets over a grid of pivot distances give the same."""
    rng = random.Random(11)
    prints = {0, (1 << 64) - 1, 7, 15}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            for b in rng.sample(range(64), rng.choice([1, 3, 4])):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(300)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = pivots.links(spark.createDataFrame(signed, "fingerprint bigint"), most=most)
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in pivots.components(found).collect()}
    wanted, groups = components_by_hand(prints), {}
    for p in prints:
        groups.setdefault(roots.get(p, p), set()).add(wanted[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(wanted.values()))
    assert found.count() <= len(prints) * len(pivots.block_masks()) * 3


def test_documents_of_near_fingerprints(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    long = [rng.choice(words) for _ in range(3000)]
    rows = [(9, " ".join(long)), (4, " ".join([*long[:1500], "changed", *long[1501:]])), (5, "a b"), (6, "A  b"), (7, None), (8, ""), (None, " \n"), (None, "alone here now"), (1, "some other text of its own"), (9, "some other text of its own")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id bigint, text string, fingerprint string, root string, least string")
    found = pivots.near_groups(docs)
    by_text = {(r["doc_id"], r["fingerprint"] % (1 << 64)): r["component_id"] for r in found.collect()}
    prints = {simhash_by_hand(t) for _, t in rows}
    roots, least = components_by_hand(prints), {}
    for i, t in rows:
        r = roots[simhash_by_hand(t)]
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert by_text == {(i, simhash_by_hand(t)): least[roots[simhash_by_hand(t)]] for i, t in rows}
    assert by_text[9, simhash_by_hand(rows[0][1])] == 4 and found.count() == len(rows)
    assert pivots.near_groups(docs.limit(0)).count() == 0


def test_no_link_passes_the_pivot_test_unseen():
    """The table of a pair within 3 bits never differs by more than 3 in a coordinate."""
    rng = np.random.default_rng(1)
    refs = np.array(pivots.references(), np.int64).view(np.uint64)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    table = lambda x: np.bitwise_count(x[:, None] ^ refs[None]).astype(int)
    assert (np.abs(table(a) - table(b)) <= 2).all()
