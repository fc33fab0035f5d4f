"""Packing documents into sequences by cutting-stock column generation.

Each document is tokenised and cut at multiples of the sequence length; the last piece is the item to pack. Item
lengths go into classes of CLASS_WIDTH tokens (rounded up), whose histogram is of fixed size. A linear program over
packing patterns is solved by column generation: a knapsack dynamic program prices new patterns against the duals.
Patterns are used as often as the rounded-down solution says; what is left is packed best-fit by class. Items are
ranked within their class without any sort: rank in the task plus the counts of the tasks before.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; a null doc_id stays null; an
empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, table, written

SEQUENCE, CLASS_WIDTH, END_ID = 4096, 8, 2
#: The restricted linear program ends when it is proven to be within this share of the optimum.
GAP = 0.005
#: Words whose ids a worker keeps; a full cache starts anew.
CACHED_WORDS, LONGEST_CACHED = 1_000_000, 40
#: Letters whose lower case and normal form are one to one, and marks that make one token run of their own.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")

PIECES = "part int, class int, class_rank bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and no token spans it, so a text is cut at blanks and line ends and the parts'
    ids are kept and joined. Parts of plain Latin letters and end marks, which its normaliser only lower-cases and its
    pre-tokenizer cuts between the two, go to its model directly; all others go through the whole tokenizer.
    test_packing holds this against whole-text calls.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.tokenize = self.tokenizer.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [c for c in range(256) if c not in plain]
        self.symbols = {c: 256 + k for k, c in enumerate(rest)}  # the byte-level alphabet's code points

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            tokens = self.tokenize(word.encode().decode("latin-1").translate(self.symbols))
            ids = self.known[word] = np.array([t.id for t in tokens], "<u4").tobytes()
        return ids

    def _learn(self, parts: list[str]) -> None:
        others = []
        for part in parts:
            if plain := PLAIN.fullmatch(part):
                self.known[part] = self._word(plain[1].lower()) + (self._word(plain[2]) if plain[2] else b"")
            else:
                others.append(part)
        for part, coded in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False)):
            self.known[part] = np.array(coded.ids, "<u4").tobytes()

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            parts = text.replace("\n", " ").split(" ")
            known = self.known
            missing = [p for p in set(parts) if p not in known]
            if missing and len(known) + 2 * len(missing) > CACHED_WORDS:
                self.known = known = {"": b""}
                missing = [p for p in set(parts) if p]
            if missing:
                self._learn(missing)
            yield b"".join([known[p] for p in parts])
            for part in missing:
                if len(part) > LONGEST_CACHED:
                    known.pop(part, None)
                    known.pop(part.lower(), None)


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker's encoder: it keeps its words from task to task."""
    return Encoder(path)


def _cut(path: str, sequence: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part = encoder(path), TaskContext.get().partitionId()
        ranks = np.zeros(-(-sequence // width) + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.texts(texts)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, sequence):
                    length = min(sequence, total - start)
                    kind = -(-length // width)
                    rows.append((part, kind, int(ranks[kind]), doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
                    ranks[kind] += 1
            if rows:
                names = [x.split()[0] for x in PIECES.split(", ")]
                types = [pa.int32(), pa.int32(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest dual value: an unbounded knapsack over the classes, by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, values = sizes[order], duals[order]
    fits = np.searchsorted(small, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            found = best[room - small[:k]] + values[:k]
            top = int(found.argmax())
            if found[top] > best[room] + 1e-12:
                best[room], took[room] = found[top], order[top]
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often the linear program uses each: revised simplex, columns generated by price()."""
    basis = np.diag(capacity // sizes).astype(np.int64)  # columns are patterns
    inverse = np.diag(1.0 / (capacity // sizes))
    use = inverse @ demand
    bound = 0.0
    while True:
        duals = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = price(sizes, duals, capacity)
        bound = max(bound, float(duals @ demand) / max(value, 1.0))
        if value <= 1 + 1e-9 or use.sum() <= bound * (1 + gap):
            return basis.T, use
        move = inverse @ pattern
        ratio = np.where(move > 1e-9, use / np.maximum(move, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return basis.T, use
        use = use - ratio[out] * move
        use[out] = ratio[out]
        use = np.maximum(use, 0)
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[:, out] = pattern


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that together hold exactly histogram's items, each of a class's size, at most capacity a pattern."""
    out: list[tuple[dict[int, int], int]] = []
    left = {k: n for k, n in sorted(histogram.items()) if n}
    if left:
        sizes = np.array(list(left))
        patterns, use = solve(sizes, np.array(list(left.values()), float), capacity)
        for pattern, times in sorted(zip(map(tuple, patterns.tolist()), np.floor(use + 1e-9).astype(int).tolist()), reverse=True):
            for k, n in zip(sizes.tolist(), pattern):
                times = min(times, left[k] // n) if n else times
            if times > 0 and any(pattern):
                out.append(({k: n for k, n in zip(sizes.tolist(), pattern) if n}, times))
                for k, n in out[-1][0].items():
                    left[k] -= n * times
    bins: dict[int, list[dict[int, int]]] = {}  # open bins by room; the rest is a few bins for each pattern
    for k in sorted(left, reverse=True):
        for _ in range(left[k]):
            room = next((r for r in range(k, capacity + 1) if bins.get(r)), None)
            held = bins[room].pop() if room else {}
            held[k] = held.get(k, 0) + 1
            bins.setdefault((room or capacity) - k, []).append(held)
    return out + [(held, 1) for same in bins.values() for held in same]


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each class: rows (first rank, items a sequence, first sequence) in the order of ranks."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        for k, n in pattern.items():
            out.setdefault(k, []).append((used.get(k, 0), n, sequence))
            used[k] = used.get(k, 0) + n * times
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, width: int = CLASS_WIDTH) -> DataFrame:
    """One row per piece of a document (doc_id, text): where it starts there and in its sequence."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or str(public_tokenizers.path("word_bpe_49k.json"))
    pieces = written(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_cut(path, sequence, width), PIECES), "pieces")
    counts = pieces.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    # at most sequence / width rows come to the driver, whatever the input's size
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan(histogram, sequence // width))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(counts.select("part", "class", F.coalesce(before, F.lit(0)).alias("before")), ["part", "class"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            to = np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds):
                mine = kinds == k
                rows = places[int(k)]
                at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
                to[mine] = rows[at, 2] + (ranks[mine] - rows[at, 0]) // rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], [*batch.schema.names, "sequence_id"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank"]
    placed = ranked.withColumn("rank", F.col("before") + F.col("class_rank")).select(*columns)
    placed = placed.mapInArrow(place, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int, rank bigint, sequence_id bigint")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("bigint").alias("offset")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
