"""Suffix-array dedup: bytes of texts that lie in a string of LENGTH bytes which also starts elsewhere.

Every string of LENGTH bytes has a canonical anchor: among the hashes of its GRAM-byte grams the least one (the last of
equals), found by a sliding minimum. Equal strings have equal anchors at equal offsets, so the suffixes of the corpus fall
into blocks by anchor, and no two suffixes of different blocks share LENGTH bytes. Consecutive strings of a text with one
anchor form a unit. Units of equal text are copies as a whole; where an anchor has units of several texts, these go to
one task as a block. There the suffixes are sorted by their first LENGTH bytes; the previous and next smaller positions in
that order, with the least common prefixes on the way, give each suffix's longest previous factor, those of the reversed
positions its longest next factor, up to LENGTH. keep="first" removes later copies (longest previous factors); keep="none"
every copy (previous or next ones).

Units of one anchor are told apart by 64-bit hashes, and so are texts of one id: among n different units that share an
anchor a mistake has odds of n * n / 2**65 at most, 3e-8 for a million. All else is compared byte by byte.

Defined cases: a null text is empty; texts under LENGTH bytes keep all; rows that share doc_id and text are copies of each
other for keep="none" and one document for keep="first"; a null doc_id is an id of its own; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, bounded_batches, by_batch, mix64, range_hashes, table, utf8_values, written

LENGTH, GRAM = 200, 40
#: Anchors are sorted together until their contexts have so many bytes; strings are spread out for comparison PART at a time.
BLOCK, PART = 1 << 20, 1 << 15

UNITS = "anchor bigint, unit bigint, doc_id bigint, text_hash bigint, s int, u int, t int, e int, m int"
CONTEXTS = "anchor bigint, doc_id bigint, text_hash bigint, s int, context binary"
SPANS = "doc_id bigint, text_hash bigint, s int, e int"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>"

_GRAMS, _UNITS = Powers(0x2545F4914F6CDD1D), Powers(0x5851F42D4C957F2D)
_LOW = np.uint64(0xFFFFFFFF)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values, from the minima of block prefixes and suffixes."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def units(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of equal units that overlap, as in periodic text: anchor, unit hash, s, u, t, e and m of each.

    The run's first unit is text[s:u], its second one starts at t (at e if there is none), the last one ends at e; m is
    their number.
    """
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 7
    at = np.arange(n - gram + 1)
    grams = range_hashes(data, at, at + gram, _GRAMS)
    keys = (grams & ~_LOW) | (_LOW - at.astype(np.uint64))
    anchor = (_LOW - (sliding_min(keys, length - gram + 1) & _LOW)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    end = np.concatenate([first[1:] - 1, [len(anchor) - 1]]) + length
    found = range_hashes(data, first, end, _UNITS)
    place = (anchor[first] - first).astype(np.uint64)
    found = mix64(found ^ mix64(place * np.uint64(1 << 32) + (end - first).astype(np.uint64)))
    order = np.argsort(found, kind="stable")  # equal units together, in text order
    found, first, end, anchor = found[order], first[order], end[order], anchor[first[order]]
    head = np.concatenate([[True], (found[1:] != found[:-1]) | (first[1:] > end[:-1])])
    start = np.flatnonzero(head)
    stop = np.concatenate([start[1:], [len(first)]]) - 1
    count = stop - start + 1
    second = np.where(count > 1, first[np.minimum(start + 1, len(first) - 1)], end[start])
    return grams[anchor[start]].view(np.int64), found[start].view(np.int64), first[start], end[start], second, end[stop], count


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at `at`, sorted by their first `length` bytes and, where these are equal, as they come; and
    how many bytes, up to length, each has in common with the one before it in that order.

    More than PART suffixes are dealt by their next 8 bytes until a part is small enough to be spread out and sorted.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    spread = np.lib.stride_tricks.sliding_window_view(padded, length)
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    sorted_parts: list[np.ndarray] = []
    waiting = [(np.arange(len(at)), 0)]  # a stack: the part that comes first lies on top
    while waiting:
        part, depth = waiting.pop()
        if depth >= length or len(part) < 2:
            sorted_parts.append(part)
        elif len(part) <= PART:
            sorted_parts.append(part[np.argsort(spread[at[part]].view(f"V{length}").ravel(), kind="stable")])
        else:
            keys = eights[at[part] + depth].view(">u8").ravel().astype(np.uint64) >> np.uint64(8 * max(depth + 8 - length, 0))
            order = np.argsort(keys, kind="stable")
            part, keys = part[order], keys[order]
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(part)]])
            cuts, k = [], 0
            while k < len(bounds) - 1:
                last = max(int(np.searchsorted(bounds, bounds[k] + PART, "right")) - 1, k + 1)
                alone = last == k + 1
                cuts.append((part[bounds[k] : bounds[last]], depth + 8 if alone else depth))
                k = last
            waiting += cuts[::-1]
    order = np.concatenate([*sorted_parts, np.zeros(0, int)]).astype(int)
    shared = np.zeros(len(order), np.int64)
    for k in range(1, len(order), PART):
        here, before = at[order[k : k + PART]], at[order[k - 1 : k - 1 + PART]]
        before = before[: len(here)]
        differ = spread[here] != spread[before]
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        shared[k : k + len(here)] = np.minimum(found, len(data) - np.maximum(here, before))
    return order, shared


def _previous_smaller(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place before with a smaller value, -1 for none, and the least of `shared` on the way.

    Every place looks at the one before; while that is larger, it goes on to where that one has got to. All between stay
    larger, so that some log(n) rounds over ever fewer places do it.
    """
    before, low = np.arange(-1, len(values) - 1), shared.copy()
    active = np.arange(1, len(values))
    while len(active):
        active = active[values[before[active]] > values[active]]
        via = before[active]
        low[active] = np.minimum(low[active], low[via])
        before[active] = before[via]
        low[active[before[active] < 0]] = 0
        active = active[before[active] >= 0]
    return before, low


def smaller_positions(positions: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of a suffix order, the nearest places before and after it with a smaller position, -1 for none, and
    the length of the longest factor that its suffix shares with one of them: its longest previous factor.

    positions: of each place's suffix in the corpus; shared: the bytes that each place's suffix shares with the one before.
    """
    n = len(positions)
    before, low = _previous_smaller(positions, shared)
    after, low_after = _previous_smaller(positions[::-1], np.concatenate([shared[:1] * 0, shared[1:][::-1]]))
    after, low_after = after[::-1], low_after[::-1]
    return before, np.where(after < 0, -1, n - 1 - after), np.maximum(low, low_after)


def longest_previous_factors(text: bytes) -> np.ndarray:
    """The longest factor at each byte that also starts earlier."""
    data = np.frombuffer(text, np.uint8)
    order, shared = suffix_order(data, np.arange(len(data)), max(len(data), 1))
    out = np.zeros(len(data), np.int64)
    out[order] = smaller_positions(order, shared)[2]
    return out


def copies(contexts: list[bytes], orders: np.ndarray, length: int, keep: str) -> list[np.ndarray]:
    """For each context, which of its strings of `length` bytes are removed; orders: the contexts' rank in the corpus."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    first = np.cumsum(sizes) - sizes
    strings = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), strings)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    corpus = np.lexsort((offset, orders[owner]))  # the strings in the order of the corpus
    order, shared = suffix_order(data, (first[owner] + offset)[corpus], length)
    factors = smaller_positions(order, shared)[2]
    if keep == "none":  # the longest next factors are the previous ones of the positions counted from the end
        factors = np.maximum(factors, smaller_positions(-order, shared)[2])
    removed = np.zeros(len(owner), bool)
    removed[corpus[order]] = factors >= length
    return np.split(removed, np.cumsum(strings)[:-1])


def _unit_rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    parts = []
    for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), utf8_values(batch.column("text"))):
        anchor, unit, *places = units(text)
        if len(anchor):
            parts.append((anchor, unit, doc_id, text_hash, *places))
    if not parts:
        return None
    sizes = [len(p[0]) for p in parts]
    joined = lambda k: np.concatenate([p[k] for p in parts])
    ids = pa.array([p[2] for p in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), sizes)))
    hashes = np.repeat(np.array([p[3] for p in parts], np.int64), sizes)
    return pa.RecordBatch.from_arrays(
        [pa.array(joined(0)), pa.array(joined(1)), ids, pa.array(hashes), *[pa.array(joined(k).astype(np.int32)) for k in range(4, 9)]],
        [x.split()[0] for x in UNITS.split(", ")],
    )


def _context_rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = []
    for row in batch.to_pylist():
        text = row["text"].encode()
        rows += [(w["anchor"], row["doc_id"], row["text_hash"], w["s"], text[w["s"] : w["u"]]) for w in row["wanted"]]
    if not rows:
        return None
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in CONTEXTS.split(", ")])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _blocks(length: int, keep: str):
    """Over contexts sorted by anchor: the removed byte spans of every block."""

    def spans(rows: list[tuple]) -> list[tuple]:
        order = sorted(range(len(rows)), key=lambda k: tuple((v is not None, v or 0) for v in rows[k][1:4]))
        orders = np.zeros(len(rows), np.int64)
        orders[order] = np.arange(len(rows))
        out = []
        for row, removed in zip(rows, copies([r[4] for r in rows], orders, length, keep)):
            for a, b in zip(*_runs(removed)):
                out.append((row[1], row[2], row[3] + int(a), row[3] + int(b) - 1 + length))
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "text_hash", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        size, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != last and size > BLOCK:
                    if out := spans(list(held.values())):
                        yield batch_of(out)
                    held, size = {}, 0
                if row[:4] not in held:  # rows that share id and text send one context
                    held[row[:4]] = row
                    size += len(row[4])
                last = row[0]
        if held and (out := spans(list(held.values()))):
            yield batch_of(out)

    return run


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), utf8_values(batch.column("text")), batch.column("spans").to_pylist()):
        merged: list[list[int]] = []
        for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        digest, at = hashlib.sha256(), 0
        for s, e in merged:
            digest.update(text[at:s])
            at = e
        digest.update(text[at:])
        rows.append((doc_id, len(text), sum(e - s for s, e in merged), len(merged), digest.hexdigest(), [{"start": s, "end": e} for s, e in merged]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def shared_anchors(rows: DataFrame) -> DataFrame:
    """Anchors of more than one unit row, with whether these have several texts (mixed). An anchor is summed up in its least and greatest unit before
    it moves, so that one with very many rows is small."""
    found = rows.groupBy("anchor").agg(F.min("unit").alias("low"), F.max("unit").alias("high"), F.sum("m").alias("n"))
    return found.filter("n > 1").select(F.col("anchor").alias("a"), (F.col("low") != F.col("high")).alias("mixed"))


def repeated_bytes(docs: DataFrame, keep: str = "first") -> DataFrame:
    """One row per document: its removed byte spans, their number and size, and the hash of what is left."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    rows = written(texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(by_batch(_unit_rows), UNITS), "units")
    # unit rows move once, to meet their anchor; all that moves after that is of anchors that occur more than once. A merge join can split a hot anchor
    anchors = written(shared_anchors(rows), "anchors").hint("merge")
    shared = written(rows.join(anchors, F.col("anchor") == F.col("a")).drop("a"), "shared")
    units_ = shared.groupBy("anchor", "unit", "mixed").agg(F.sum("m").alias("n"), F.min(F.struct("doc_id", "text_hash", "s", "u")).alias("first"))
    flagged = written(units_.filter("n > 1 or mixed"), "flagged")
    many = flagged.filter("n > 1").select(F.col("anchor").alias("a"), F.col("unit").alias("b"), "first")
    copied = shared.join(many, (F.col("anchor") == F.col("a")) & (F.col("unit") == F.col("b")))
    if keep == "first":
        is_first = F.struct("doc_id", "text_hash", "s", "u").eqNullSafe(F.col("first"))
        copied = copied.filter(~is_first | (F.col("m") > 1)).withColumn("s", F.when(is_first, F.col("t")).otherwise(F.col("s")))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    wanted = flagged.filter("mixed").select("anchor", "first.*").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "s", "u")).alias("wanted"))
    asked = texts.alias("t").join(wanted.alias("w"), same("t", "w")).select("t.doc_id", "t.text_hash", "t.text", "w.wanted")
    contexts = asked.mapInArrow(by_batch(_context_rows), CONTEXTS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts = contexts.repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = contexts.mapInArrow(_blocks(LENGTH, keep), SPANS)
    spans = copied.select("doc_id", "text_hash", "s", "e").unionByName(found)
    spans = written(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    joined = texts.alias("t").join(spans.alias("w"), same("t", "w"), "left").select("t.doc_id", "t.text", "w.spans")
    return joined.mapInArrow(by_batch(_cut), RESULT)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"), keep="none").drop("spans")


QUERIES = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
ORACLE_SQL = {
    "op2_suffix_array_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, sha256(array_slice(b, i, i + {LENGTH - 1})) AS h FROM (SELECT r, b, unnest(generate_series(1, octet_length(b) - {LENGTH - 1})) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH}, true) AS opens FROM w SEMI JOIN c USING (h)),
g AS (SELECT r, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM (SELECT r, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS k FROM s) GROUP BY r, k),
k AS (
  SELECT r, a, z, hex(array_slice(b, coalesce(lag(z) OVER o, 0) + 1, a - 1)) AS before, lead(a) OVER o IS NULL AS is_last, hex(array_slice(b, z + 1, octet_length(b))) AS rest
  FROM g JOIN d USING (r) WINDOW o AS (PARTITION BY r ORDER BY a)
), f AS (
  SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans, sha256(unhex(string_agg(before || CASE WHEN is_last THEN rest ELSE '' END, '' ORDER BY a))) AS kept FROM k GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  coalesce(kept, sha256(b)) AS kept_sha256 FROM d LEFT JOIN f USING (r)"""
}
