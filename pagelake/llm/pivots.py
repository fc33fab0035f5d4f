"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the bitwise majority of its word shingles' hashes. For each distinct fingerprint a table of its Hamming
distances to PIVOTS reference fingerprints is computed once. By the triangle inequality a pair whose tables differ by more than the allowed
bits in any coordinate is no link, so such pairs are discarded and only survivors are verified on the fingerprints themselves.

Pairs meet where they can be links at all: of bits + EQUAL blocks, a link has EQUAL equal ones at least, so each fingerprint goes to one bucket
for each choice of EQUAL blocks. Within a bucket rows are sorted by their distance to the first pivot, and compared as far as that coordinate
allows. A bucket of more than MOST fingerprints is dealt over a grid of the first pivots' distances: cells are CELL wide, and a fingerprint within
the allowed bits below the next cell goes there too, so that each link meets in a cell. All links are found; pairs never become rows: a task
returns, for each fingerprint of a bucket, one that links lead to.

Defined cases: a null text is empty; fewer words than a shingle are one shingle; no words give fingerprint zero, which links like any other; repeated
rows are documents of their own; a null doc_id counts as a document, but as a component's smallest only where no other is; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, by_batch, table, utf8_values, written
from .near import components

SHINGLE, SEED, BITS = 3, 42, 3
PIVOTS, EQUAL = 16, 3
#: Fingerprints of a bucket from which on it is dealt over a grid of pivot distances, and the width of the grid's cells.
MOST, CELL = 4096, 8
#: What a level of the grid leaves of a cell, about: it has 2 to 3 cells, and 3 in 8 rows go to two.
LEVEL = 1.6


def _lanes(hashes: np.ndarray) -> int:
    """The majority of each bit, ties 0."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.count_nonzero(bits, axis=0) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return _lanes(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    shingles = map(joined.__getitem__, map(slice, starts, ends[size - 1 :].tolist()))
    return _lanes(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (bigint) of every document."""
    bounded_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([simhash(text, size) for text in utf8_values(batch.column("text"))], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(by_batch(run), "doc_id bigint, fingerprint bigint")


def references(count: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints, as signed integers."""
    return [int(x) for x in np.random.default_rng(20240713).integers(-(1 << 63), (1 << 63) - 1, count, dtype=np.int64)]


def distance_table(fingerprint: Column, refs: list[int]) -> list[Column]:
    """The distances to the references, a byte each, packed into columns d0, d1... of eight."""
    out = []
    for k in range(0, len(refs), 8):
        packed = F.lit(0).cast("bigint")
        for j, ref in enumerate(refs[k : k + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fingerprint.bitwiseXOR(F.lit(ref))).cast("bigint"), 8 * j))
        out.append(packed.alias(f"d{k // 8}"))
    return out


def _coordinate(k: int) -> Column:
    return F.shiftright(F.col(f"d{k // 8}"), 8 * (k % 8)).bitwiseAND(F.lit(127))


def block_masks(bits: int = BITS) -> list[int]:
    """For each choice of EQUAL of bits + EQUAL blocks, the mask of its bits."""
    edges = np.linspace(0, 64, bits + EQUAL + 1).astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, EQUAL)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def meetings(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """bucket_no, bucket (the bits that its fingerprints share), fingerprint and its distance table."""
    masks = [_signed(m) for m in block_masks(bits)]
    buckets = F.array(*[F.struct(F.lit(k).alias("bucket_no"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bucket")) for k, m in enumerate(masks)])
    return distinct.select("fingerprint", *[c for c in distinct.columns if c[0] == "d" and c[1:].isdigit()], F.inline(buckets))


def gridded(met: DataFrame, hot: DataFrame, pivots: int, bits: int = BITS) -> DataFrame:
    """The rows of hot buckets (n: their fingerprints) over the cells of a grid of as many pivots as it takes."""
    levels = F.least(F.lit(pivots), F.ceil(F.log(F.col("n") / MOST) / F.log(F.lit(LEVEL)))).cast("int")
    rows = met.join(hot, ["bucket_no", "bucket"]).withColumn("levels", levels).withColumn("cell", F.lit(0).cast("bigint"))
    for k in range(pivots):
        own, inside = F.floor(_coordinate(k) / CELL), _coordinate(k) % CELL
        cells = F.when(F.lit(k) >= F.col("levels"), F.array(F.lit(0).cast("bigint"))).when(inside >= CELL - bits, F.array(own, own + 1)).otherwise(F.array(own))
        rows = rows.withColumn("c", F.explode(cells)).withColumn("cell", F.xxhash64("cell", "c")).drop("c")
    return rows.drop("levels", "n")


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[at], at):
        at = parent[up]
    return at


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[k] and b[k] for every k; a set's root is its least place."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def linked(group: np.ndarray, prints: np.ndarray, tables: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and first coordinate: places with links, and the place that they lead to.

    Neighbours at growing offsets are compared for all groups at once, for as long as any two share a group and the first coordinate
    allows a link; rows of one set already are not compared again.
    """
    n, parent = len(prints), np.arange(len(prints))
    active, offset = np.arange(n - 1), 1
    first = tables[:, 0]
    while len(active):
        active = active[active + offset < n]
        other = active + offset
        near = (group[active] == group[other]) & (first[other] - first[active] <= bits)
        active, other = active[near], other[near]
        apart = _roots(parent, active) != _roots(parent, other)
        a, b = active[apart], other[apart]
        survivors = (np.abs(tables[a] - tables[b]) <= bits).all(axis=1)
        a, b = a[survivors], b[survivors]
        links = np.bitwise_count(prints[a] ^ prints[b]) <= bits
        _unite(parent, a[links], b[links])
        offset += 1
    at = np.flatnonzero(parent != np.arange(n))
    return at, _roots(parent, parent[at])


def _verify(columns: list[str], tables: list[str], bits: int):
    """Over rows sorted by columns and first coordinate: pairs of fingerprints that links connect, bucket by bucket."""

    def found(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        keys = [rows.column(c).to_numpy() for c in columns]
        new = np.concatenate([[False], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        prints = rows.column("fingerprint").to_numpy()
        packed = np.stack([rows.column(c).to_numpy() for c in tables], axis=1)
        at, root = linked(np.cumsum(new), prints.view(np.uint64), np.ascontiguousarray(packed).view(np.int8).reshape(len(prints), -1), bits)
        if len(at):
            return pa.RecordBatch.from_arrays([pa.array(prints[at]), pa.array(prints[root])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # all but the last bucket are whole
            keys = [batch.column(c).to_numpy() for c in columns]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(batch.num_rows - np.argmin(same[::-1])) if not same.all() else 0
            if not cut and len(held) > 1 and any(held[-2].column(c)[held[-2].num_rows - 1].as_py() != k[0] for c, k in zip(columns, keys)):
                held, whole = held[-1:], held[:-1]
            elif cut:
                held, whole = [batch.slice(cut)], [*held[:-1], batch.slice(0, cut)]
            else:
                continue
            if (out := found(pa.Table.from_batches(whole))) is not None:
                yield out
        if held and (out := found(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def links(distinct: DataFrame, bits: int = BITS, pivots: int = PIVOTS, most: int = MOST) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect what all links of at most `bits` differing bits connect."""
    spark = distinct.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = written(distinct.select("fingerprint", *distance_table(F.col("fingerprint"), references(pivots))), "pivot-distances")
    tables = [c for c in known.columns if c != "fingerprint"]
    met = meetings(known, bits)
    hot = written(met.groupBy("bucket_no", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "hot-buckets")

    def verified(rows: DataFrame, columns: list[str]) -> DataFrame:
        dealt = rows.repartition(parts, *columns).sortWithinPartitions(*columns, _coordinate(0))
        return dealt.select(*columns, "fingerprint", *tables).mapInArrow(_verify(columns, tables, bits), "a bigint, b bigint")

    if not hot.take(1):
        return verified(met, ["bucket_no", "bucket"])
    cool = verified(met.join(hot, ["bucket_no", "bucket"], "left_anti"), ["bucket_no", "bucket"])
    return cool.unionByName(verified(gridded(met, hot, pivots, bits), ["bucket_no", "bucket", "cell"]))


def near_groups(docs: DataFrame, bits: int = BITS, size: int = SHINGLE, most: int = MOST) -> DataFrame:
    """Every document with its fingerprint (bigint) and component_id, the smallest doc_id that links lead to."""
    found = written(fingerprints(docs, size), "fingerprints")
    distinct = written(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, bits, most=most)).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(rooted.join(least, "root").select("fingerprint", "component_id"), "fingerprint")


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash": op13_simhash}
