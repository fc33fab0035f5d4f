"""N-gram Jaccard join by MinHash banding.

Documents with the same set of word five-grams form a class. A class's MinHash signature is cut into bands; classes that
share a band's hash meet in a bucket, and every pair of a bucket is verified on its full n-gram sets. No pair becomes a
row: a task verifies the pairs of a bucket's cell and returns, per class, its number of links and a root to which links
lead; a pair that meets in several buckets is counted in the first only. Buckets of the same classes are one; buckets of
more than TILE classes are dealt into tiles, so that no task holds a large bucket.

Links are counted over all pairs, in cells of two tiles: rows grow with the square of a bucket's tiles. Where only groups are
asked for (links=False, as by drop_near), each tile is compared within itself and with the bucket's first class, its
representative; only classes that lead to no representative are compared with the other tiles. For a bucket of copies
that are near each other, rows then grow with its size.

Band and row counts are the most selective ones within MOST_HASHES that reach the target recall at the threshold.

Defined cases: a null text is empty; texts without words form one class without links; a text of fewer words than the
n-gram size is one n-gram; repeated rows are copies; a null doc_id is an id of its own, smaller than others; other columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS_SQL, bounded_batches, by_batch, free_names, shingle_hashes, table, utf8_values, word_hashes, written

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9995, 128
#: Classes of a tile; a cell holds two at most.
TILE = 1024
#: Members from which a cell is verified by matrix products instead of pair by pair.
DENSE, COLUMNS = 12, 4096

SIGNATURES = "doc_id bigint, text_hash bigint, set_key binary, n_grams int, bands array<bigint>"
CELLS = "bucket bigint, i int, j int, class_no bigint, tile int, copies bigint, buckets array<bigint>, rep bigint, grams binary"
CELL_LIST = "array<struct<bucket:bigint,i:int,j:int,tile:int,rep:bigint>>"
LINKS = "class_no bigint, n_links bigint, n_class_links bigint, root bigint"


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands * rows <= most hashes reach the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def minhash(grams: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over the n-grams; blocks keep the work in cache."""
    multiply, add = family
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multiply), np.uint32(0xFFFFFFFF))
    for k in range(0, len(low), 1024):
        np.minimum(out, (low[None, k : k + 1024] * multiply[:, None] + add[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, bands: int, rows: int, size: int = NGRAM) -> DataFrame:
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    family = _hash_family(bands * rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts, found = [], [], []
        for value in utf8_values(batch.column("text")):
            grams = shingle_hashes(word_hashes(value), size)
            keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
            counts.append(len(grams))
            values = minhash(grams, family).reshape(bands, rows).tobytes() if len(grams) else b""
            width = 4 * rows
            found.append([int.from_bytes(hashlib.blake2b(bytes([k]) + values[k * width : (k + 1) * width], digest_size=8).digest(), "little", signed=True) for k in range(bands if values else 0)])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
            ["doc_id", "text_hash", "set_key", "n_grams", "bands"],
        )

    return narrow.mapInArrow(by_batch(run), SIGNATURES)


def _packed(grams: np.ndarray) -> bytes:
    """Sorted distinct n-gram hashes of 40 bits, five bytes each."""
    return np.unique(grams & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _cells(size: int):
    """A row for each cell that a class is sent to, with its n-gram set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for row in batch.to_pylist():
            grams = _packed(shingle_hashes(word_hashes(row["text"].encode()), size))
            for c in row["cells"]:
                out.append((c["bucket"], c["i"], c["j"], row["class_no"], c["tile"], row["copies"], row["ids"], c["rep"], grams))
        if not out:
            return None
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in CELLS.split(", ")])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):  # rows multiply here
                if (made := run(batch.slice(k, 100))) is not None:
                    yield made

    return sliced


def _overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each two sets share."""
    n = len(grams)
    out = np.zeros((n, n), np.float32)
    if n <= DENSE:
        for x in range(n):
            for y in range(x + 1, n):
                both = np.concatenate([grams[x], grams[y]])
                both.sort()
                out[x, y] = out[y, x] = np.count_nonzero(both[1:] == both[:-1])
        return out
    owner = np.repeat(np.arange(n), [len(g) for g in grams])
    values, at, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    owner, column = owner[keep], number[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[lo:hi], column[lo:hi] - start] = 1
        out += block @ block.T
    np.fill_diagonal(out, 0)
    return out


def verified(rows: list[dict], threshold: float) -> list[tuple[int, int, int, int]]:
    """(class, linked documents, linked classes, least class that links lead to) of a cell's classes that have links."""
    rows = list({r["class_no"]: r for r in rows}.values())
    if len(rows) < 2:
        return []
    first = rows[0]
    grams = [_unpacked(r["grams"]) for r in rows]
    sizes = np.array([len(g) for g in grams], np.float32)
    shared = _overlaps(grams)
    links = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-3
    np.fill_diagonal(links, False)
    tiles = np.array([r["tile"] for r in rows])
    if first["i"] != first["j"]:
        links &= tiles[:, None] != tiles[None, :]
    earlier = sorted({b for r in rows for b in r["buckets"] or () if b < first["bucket"]})
    if earlier:
        place = {b: k for k, b in enumerate(earlier)}
        met = np.zeros((len(rows), len(earlier)), np.float32)
        for k, r in enumerate(rows):
            met[k, [place[b] for b in r["buckets"] or () if b in place]] = 1
        links &= (met @ met.T) == 0
    if not links.any():
        return []
    numbers, copies = np.array([r["class_no"] for r in rows]), np.array([r["copies"] for r in rows])
    root = numbers.copy()
    while True:
        least = np.minimum(root, np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == root).all():
            break
        root = least
    return [(int(numbers[k]), int(copies[links[k]].sum()), int(links[k].sum()), int(root[k])) for k in np.flatnonzero(links.any(axis=1))]


def _verify(threshold: float):
    """Over rows sorted by cell: the links of each cell, a cell at a time."""
    names = ("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in names):
                    out += verified(held, threshold)
                    held = []
                held.append(row)
            if out:
                yield _rows(out)
        if held and (out := verified(held, threshold)):
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["class_no", "n_links", "n_class_links", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars; lone nodes are left out."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")


def _tile(class_no: Column, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(class_no), tiles).cast("int")


def _tiles(n: Column) -> Column:
    return F.ceil(n / TILE).cast("int")


def _sent(members: DataFrame, texts: DataFrame, threshold: float, size: int, repeats: bool, name: str) -> DataFrame:
    """The links of the cells that members (class_no, cells; ids) are sent to. repeats: rows of one id and text may be there twice."""
    found = texts.join(members, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    if repeats:  # one row a class, before its n-grams are built
        found = found.dropDuplicates(["class_no"])
    found = found.select("class_no", "copies", "ids", "cells", "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = found.mapInArrow(_cells(size), CELLS).repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return written(cells.mapInArrow(_verify(threshold), LINKS), name)


def _all_links(classes: DataFrame, met: DataFrame, buckets: DataFrame, texts: DataFrame, threshold: float, size: int, repeats: bool) -> DataFrame:
    """All pairs of every bucket, each counted in the first bucket where it meets."""
    tiles, own = _tiles(F.col("n")), _tile(F.col("class_no"), _tiles(F.col("n")))
    cells = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda x: F.struct("bucket", F.least(own, x).alias("i"), F.greatest(own, x).alias("j"), own.alias("tile"), F.lit(None).cast("bigint").alias("rep")),
    )
    members = met.withColumn("cells", cells).groupBy("class_no").agg(F.flatten(F.collect_list("cells")).alias("cells"), F.array_sort(F.collect_list("bucket")).alias("ids"))
    return _sent(classes.join(members, "class_no"), texts, threshold, size, repeats, "links")


def _group_links(classes: DataFrame, met: DataFrame, buckets: DataFrame, texts: DataFrame, threshold: float, size: int, repeats: bool) -> DataFrame:
    """Links enough to connect what all pairs would connect: each tile with its bucket's representative, then the rest."""
    own = _tile(F.col("class_no"), _tiles(F.col("n")))
    cell = lambda i, j, tile: F.struct("bucket", i.alias("i"), j.alias("j"), tile.alias("tile"), "rep")
    everywhere = F.transform(F.sequence(F.lit(0), _tiles(F.col("n")) - 1), lambda x: cell(x, x, x))
    cells = F.when(F.col("class_no") == F.col("rep"), everywhere).otherwise(F.array(cell(own, own, own)))
    unlisted = lambda df: df.groupBy("class_no").agg(F.flatten(F.collect_list("cells")).alias("cells")).withColumn("ids", F.lit(None).cast("array<bigint>"))
    first = _sent(classes.join(unlisted(met.withColumn("cells", cells)), "class_no"), texts, threshold, size, repeats, "links")
    if not buckets.filter(F.col("n") > TILE).take(1):
        return first
    hot = met.filter(F.col("n") > TILE)
    roots = components(first.select(F.col("class_no").alias("a"), F.col("root").alias("b")))
    rooted = hot.join(roots, F.col("class_no") == F.col("node"), "left").select("bucket", "n", "rep", "class_no", F.coalesce("root", "class_no").alias("root"))
    of_rep = rooted.filter("class_no = rep").select("bucket", F.col("root").alias("rep_root"))
    rooted = written(rooted.join(of_rep, "bucket").withColumn("apart", F.col("root") != F.col("rep_root")), "rooted")
    left = rooted.filter("apart").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_apart"))
    # tiles of classes apart are numbered below 0: every class meets all of them, a class apart all tiles but its own
    rooted = rooted.join(left, "bucket")
    apart_tile = -1 - _tile(F.col("class_no"), _tiles(F.col("n_apart")))
    met_by = F.transform(F.sequence(F.lit(0), _tiles(F.col("n_apart")) - 1), lambda x: cell(-1 - x, own, own))
    others = F.filter(F.sequence(F.lit(0), _tiles(F.col("n")) - 1), lambda x: x != own)  # its own tile was compared before
    meets = F.when(F.col("apart"), F.transform(others, lambda x: cell(apart_tile, x, apart_tile))).otherwise(F.array().cast(CELL_LIST))
    second = rooted.withColumn("cells", F.concat(met_by, meets))
    return first.unionByName(_sent(classes.join(unlisted(second), "class_no"), texts, threshold, size, repeats, "more-links"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = NGRAM, recall: float = RECALL, links: bool = True) -> DataFrame:
    """One row per document: its class, the class's copies, its links to other classes and the group that links connect.

    doc_id, text_hash, class_id (least doc_id of the same n-gram set), class_size, n_links (documents of other classes
    at or above the threshold), n_class_links (their classes), group_id (least doc_id of the connected classes).
    links=False: the two counts are null and groups are found with fewer comparisons.
    """
    bands, rows = banding(threshold, recall)
    signed = written(signatures(docs, bands, rows, size), "signatures")
    grouped = signed.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")
    )
    # numbers are fixed by the write; they are unique whatever the ids are
    classes = written(grouped.withColumn("class_no", F.monotonically_increasing_id()), "classes")
    met = classes.select("class_no", F.explode("bands").alias("bucket"))
    one, two = F.xxhash64("class_no"), F.xxhash64(F.lit(1), F.col("class_no"))
    buckets = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class_no").alias("rep"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y")).filter("n > 1")
    buckets = written(buckets.groupBy("n", "rep", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "rep"), "buckets")
    met = met.join(buckets, "bucket")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("d"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    repeats = bool(signed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1))
    found = (_all_links if links else _group_links)(classes.select("class_no", "least.doc_id", "least.text_hash", "copies"), met, buckets, texts, threshold, size, repeats)
    roots = components(found.select(F.col("class_no").alias("a"), F.col("root").alias("b")))
    joined = classes.join(roots, F.col("class_no") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class_no"))
    lowest = joined.groupBy("root").agg(F.min("least").alias("lowest"))
    count = lambda name: (F.coalesce(F.col(name), F.lit(0)) if links else F.lit(None)).cast("bigint").alias(name)
    joined = joined.join(lowest, "root")
    if links:
        total = found.groupBy("class_no").agg(F.sum("n_links").alias("n_links"), F.sum("n_class_links").alias("n_class_links"))
        joined = joined.join(total, "class_no", "left")
    joined = joined.select(
        "set_key",
        F.col("least.doc_id").alias("class_id"),
        F.col("copies").alias("class_size"),
        count("n_links"),
        count("n_class_links"),
        F.col("lowest.doc_id").alias("group_id"),
        F.col("lowest.text_hash").alias("group_hash"),
    )
    return signed.select("doc_id", "text_hash", "set_key").join(joined, "set_key").drop("set_key")


def _kept(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def drop_near(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near copies, that of the least doc_id; columns as they were."""
    own, text, n = free_names(docs, "__id", "__hash", "__n")
    (key,) = free_names(docs, "__text")
    found = near_classes(docs, threshold, links=False)
    same = F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("text_hash") == F.col("group_hash"))
    keep = found.filter(same).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    keep = written(keep.select(F.col("doc_id").alias(own), F.col("text_hash").alias(text), F.col("n").alias(n)), "kept")
    joined = docs.withColumn(key, _kept(docs)).join(keep, F.col("doc_id").cast("bigint").eqNullSafe(F.col(own)) & (F.col(key) == F.col(text)))
    once = joined.filter(F.col(n) == 1).select(*docs.columns)
    if not keep.filter(F.col(n) > 1).take(1):
        return once
    # rows repeated with their id and text: one of each stays
    return once.unionByName(joined.filter(F.col(n) > 1).dropDuplicates([own, text]).select(*docs.columns))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "n_class_links", "group_id")


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
ORACLE_SQL = {
    "op5_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - {NGRAM - 1}), lambda o: array_to_string(w[o:o + {NGRAM - 1}], ' ')))) END AS g FROM d
), c AS (SELECT min(doc_id) AS class_id, count(*) AS class_size, g FROM s GROUP BY g),
e AS MATERIALIZED (SELECT class_id, len(g) AS n, unnest(list_transform(g, lambda x: hash(x))) AS h FROM c),
p AS (
  SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.h = b.h AND a.class_id <> b.class_id GROUP BY 1, 2
), l AS MATERIALIZED (SELECT a, b FROM p WHERE shared >= {THRESHOLD} * (na + nb - shared)),
r(class_id, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.class_id),
g AS (SELECT class_id, min(root) AS root FROM r GROUP BY class_id),
n AS (SELECT l.a AS class_id, sum(c.class_size) AS n_links, count(*) AS n_class_links FROM l JOIN c ON c.class_id = l.b GROUP BY 1)
SELECT s.doc_id, c.class_id, CAST(class_size AS BIGINT) AS class_size, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_class_links, 0) AS BIGINT) AS n_class_links,
  coalesce(g.root, c.class_id) AS group_id FROM s JOIN c ON s.g = c.g LEFT JOIN g ON g.class_id = c.class_id LEFT JOIN n ON n.class_id = c.class_id"""
}
