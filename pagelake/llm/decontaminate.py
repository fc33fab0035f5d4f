"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each segment (one Arrow batch of documents) stores, for every term, the
positions at which it stands. A search takes the benchmark in blocks of bounded size; in each segment the windows
of a block start from the posting list of their rarest term (by its count over the whole corpus) and intersect it
with the offset-adjusted lists of the others, rarest first. No posting is ever shuffled; only term counts are.

Defined cases: a null or empty text has no words and no hits; a null doc_id stays null; repeated rows are judged
row by row; items of equal item_id count once; a null item_id is named by the empty string; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS_SQL, bounded_batches, free_names, table, utf8_values, words_of, written

WINDOW_WORDS = 10
#: Bytes of benchmark text, and windows, in a block; the corpus index is searched once for each block. A longer item is
#: searched in pieces that share all but one word of a window.
BLOCK_BYTES, BLOCK_WINDOWS = 8 << 20, 1 << 18
#: Candidates of a segment that are held at a time.
CANDIDATES = 1 << 21
#: Words after which a segment of long documents ends.
SEGMENT_WORDS = 2_000_000

INDEX_SCHEMA = "segment string, doc_ids array<bigint>, n_words array<int>, terms binary, counts binary, positions binary"
MATCH_SCHEMA = "segment string, doc_no int, doc_id bigint, n_words bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<i4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i4")


def _segment(name: str, doc_ids: list, sizes: list[int], tokens: list[np.ndarray], ids: dict[bytes, int]) -> pa.RecordBatch:
    stream = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
    order = np.argsort(stream, kind="stable").astype(np.int32)
    counts = np.bincount(stream, minlength=len(ids))
    steps = np.diff(order, prepend=np.int32(0))
    starts = np.cumsum(counts) - counts
    steps[starts] = order[starts]  # each list starts with its first position itself
    arrays = [
        pa.array([name]),
        pa.array([doc_ids], pa.list_(pa.int64())),
        pa.array([sizes], pa.list_(pa.int32())),
        pa.array([zstandard.compress(b" ".join(ids), 1)]),
        pa.array([_pack(counts)]),
        pa.array([_pack(steps)]),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["segment", "doc_ids", "n_words", "terms", "counts", "positions"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment for each batch of documents, or for SEGMENT_WORDS words of a batch of long ones."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids: dict[bytes, int] = {}
        doc_ids, sizes, tokens, held = [], [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8_values(batch.column("text"))):
            words = words_of(text)
            doc_ids.append(doc_id)
            sizes.append(len(words))
            tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
            held += len(words)
            if held > SEGMENT_WORDS:
                yield _segment(f"{part}-{number}", doc_ids, sizes, tokens, ids)
                ids, doc_ids, sizes, tokens, held, number = {}, [], [], [], 0, number + 1
        if doc_ids:
            yield _segment(f"{part}-{number}", doc_ids, sizes, tokens, ids)
            number += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of docs (doc_id, text), stored in the shared folder: one row for each segment."""
    bounded_batches(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_segments, INDEX_SCHEMA), "postings")


class Block:
    """A block of benchmark windows: terms numbered, each window's terms ordered from the rarest on."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        rows = []
        for item, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            size = min(window, len(ids))
            rows += [(item, ids[k : k + size]) for k in range(len(ids) - size + 1) if size]
        self.item = np.array([r[0] for r in rows], np.int32)
        self.length = np.array([len(r[1]) for r in rows], np.int32)
        self.terms = np.full((len(rows), window), -1, np.int32)
        for k, (_, ids) in enumerate(rows):
            self.terms[k, : len(ids)] = ids
        self.offsets = np.tile(np.arange(window, dtype=np.int32), (len(rows), 1))

    def rank(self, frequency: np.ndarray) -> None:
        """Puts each window's terms in the order of their corpus frequency; places past its end come last."""
        keys = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        order = np.argsort(keys, axis=1, kind="stable")
        self.terms, self.offsets = np.take_along_axis(self.terms, order, 1), np.take_along_axis(self.offsets, order, 1)


def _term_numbers(terms: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    words = zstandard.decompress(terms).split(b" ")
    return np.fromiter((vocabulary.get(w, -1) for w in words), np.int32, len(words))


def _frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each term of a block stands in the corpus; one number a term comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                if len(found := _unpack(counts)):
                    numbers = _term_numbers(terms, vocabulary)
                    total[numbers[numbers >= 0]] += found[numbers >= 0]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(max(len(vocabulary), 1), np.int64)
    parts = index.select("terms", "counts").mapInArrow(count, "term bigint, n bigint")
    for row in parts.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.term] = row.n
    return out


class Segment:
    """One segment's posting lists of the terms of a block."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        self.sizes = np.array(row["n_words"], np.int64)
        self.ends = np.cumsum(self.sizes)
        counts, steps = _unpack(row["counts"]), _unpack(row["positions"])
        self.lists: dict[int, np.ndarray] = {}
        self.total = len(steps)
        if len(steps):
            stops = np.cumsum(counts)
            numbers = _term_numbers(row["terms"], vocabulary)
            for k in np.flatnonzero(numbers >= 0):
                self.lists[int(numbers[k])] = np.cumsum(steps[stops[k] - counts[k] : stops[k]], dtype=np.int64)
        # all lists in the order of their terms, with the term in front of each position, so that one search serves many lists
        self.postings = np.concatenate([t * self.total + self.lists[t] for t in sorted(self.lists)]) if self.lists else np.zeros(0, np.int64)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, side="right")

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is on its term's list."""
        keys = terms.astype(np.int64) * self.total + positions
        at = np.minimum(np.searchsorted(self.postings, keys), len(self.postings) - 1)
        return self.postings[at] == keys

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) for each exact occurrence that lies in one document."""
        none = np.zeros(0, np.int64)
        if not self.lists or not len(block.item):
            return none, none
        sizes = np.zeros(max(len(block.vocabulary), 1), np.int64)
        for term, found in self.lists.items():
            sizes[term] = len(found)
        live = np.flatnonzero((np.where(block.terms >= 0, sizes[block.terms], 1) > 0).all(axis=1))
        outs: list[tuple[np.ndarray, np.ndarray]] = []
        load = np.cumsum(sizes[block.terms[live, 0]])
        for part in np.split(live, np.searchsorted(load, np.arange(CANDIDATES, load[-1] if len(load) else 0, CANDIDATES))):
            if not len(part):
                continue
            lists = [self.lists[int(t)] for t in block.terms[part, 0]]
            window = np.repeat(part, [len(x) for x in lists])
            start = np.concatenate(lists) - block.offsets[window, 0]
            ok = (start >= 0) & (start + block.length[window] <= self.total)
            window, start = window[ok], start[ok]
            for k in range(1, block.terms.shape[1]):
                term = block.terms[window, k]
                ok = (term < 0) | self.holds(term, start + block.offsets[window, k])
                window, start = window[ok], start[ok]
            ok = self.doc_of(start) == self.doc_of(start + block.length[window] - 1)
            outs.append((window[ok], start[ok]))
        if not outs:
            return none, none
        return np.concatenate([x[0] for x in outs]), np.concatenate([x[1] for x in outs])

    def near(self, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest word) wherever all its words stand within slop words of that one, in any order."""
        windows, places = [], []
        for w in range(len(block.item)):
            terms = [int(t) for t in dict.fromkeys(block.terms[w].tolist()) if t >= 0]
            if not all(t in self.lists for t in terms):
                continue
            at = self.lists[terms[0]]
            doc = self.doc_of(at)
            low, high = np.maximum(at - slop, self.ends[doc] - self.sizes[doc]), np.minimum(at + slop, self.ends[doc] - 1)
            for t in terms[1:]:
                ok = np.searchsorted(self.lists[t], low) < np.searchsorted(self.lists[t], high, side="right")
                at, low, high = at[ok], low[ok], high[ok]
            windows.append(np.full(len(at), w))
            places.append(at)
        return (np.concatenate(windows), np.concatenate(places)) if windows else (np.zeros(0, int), np.zeros(0, int))


def _search(block: Block, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, block.vocabulary)
                window, start = segment.phrases(block) if slop is None else segment.near(block, slop)
                length = block.length[window] if slop is None else np.ones(len(window), np.int64)
                doc = segment.doc_of(start)
                first = segment.ends - segment.sizes
                spans: list[list] = [[] for _ in segment.sizes]
                items: list[set] = [set() for _ in segment.sizes]
                order = np.lexsort((start + length, start))
                for d, i in set(zip(doc.tolist(), block.item[window].tolist())):
                    items[d].add(block.names[i])
                for d, s, e in zip(doc[order].tolist(), (start - first[doc])[order].tolist(), (start + length - first[doc])[order].tolist()):
                    if spans[d] and s <= spans[d][-1]["end"]:
                        spans[d][-1]["end"] = max(e, spans[d][-1]["end"])
                    else:
                        spans[d].append({"start": s, "end": e})
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * n, pa.string()),
                        pa.array(range(n), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(segment.sizes, pa.int64()),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    ["segment", "doc_no", "doc_id", "n_words", "items", "spans"],
                )

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int, block_windows: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, size, windows = [], 0, 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").toLocalIterator():
        words = words_of((row.text or "").encode())
        for k in range(0, max(len(words) - window + 1, 1), block_windows):
            piece = words[k : k + block_windows + window - 1]
            own_size, own = sum(map(len, piece)) + len(piece), max(len(piece) - window + 1, 1)
            if block and (size + own_size > block_bytes or windows + own > block_windows):
                yield block
                block, size, windows = [], 0, 0
            block.append((row.name, piece))
            size, windows = size + own_size, windows + own
    yield block


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, slop: int | None = None, block_bytes: int = BLOCK_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per indexed document: its words, the items met and the merged word spans that they cover.

    slop None: exact phrases of `window` consecutive item words (a shorter item is one phrase). Else proximity: places
    of a window's rarest word with all its other words at most slop words away, in any order.
    """
    parts = []
    blocks = _blocks(benchmark, window, block_bytes, block_windows)
    items = next(blocks)
    while items is not None:
        block = Block(items, window)
        block.rank(_frequencies(index, block.vocabulary))
        items = next(blocks, None)
        found = index.mapInArrow(_search(block, slop), MATCH_SCHEMA)
        parts.append(found if items is None and not parts else written(found, "matches"))
    if len(parts) == 1:
        return parts[0]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return both.groupBy("segment", "doc_no", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), merged.alias("spans")
    )


def digest(matches: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return matches.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    return digest(search(index, table(spark, sf_dir, "benchmark")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; columns as they were.

    Rows go by a 64-bit hash of their id and text: with n rows, c of them hit, n * c / 2**64 clean ones go by mistake.
    """
    (row,) = free_names(docs, "__row")
    hit = digest(search(build_index(keyed(docs)), benchmark)).filter("contaminated").select(F.col("doc_id").alias(row)).distinct()
    return keyed(docs, row).join(hit, row, "left_anti").select(*docs.columns)


def keyed(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """docs with a 64-bit key of the row's id and text in the column `name`; rows alike in both are judged alike."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id"), F.col("text")))

QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE_SQL = {
    "op4_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, k, array_to_string(w[o:o + k - 1], ' ') AS g FROM (
    SELECT item, w, least({WINDOW_WORDS}, len(w)) AS k, unnest(generate_series(1, len(w) - least({WINDOW_WORDS}, len(w)) + 1)) AS o FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, o, array_to_string(w[o:o + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS o FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), m AS (SELECT doc_id, k, o, item FROM dw JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(o, o + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, o FROM m)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
}
