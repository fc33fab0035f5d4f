"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A sketch keeps every hash of a five-word shingle that lies below a fixed fraction of the hash range, and the smallest
hash where none does, so sketches of any two texts can be compared whatever their lengths. Sketches merge by union, without
hashes over the threshold where one below it is there (merged()): that is the sketch of all their shingles. Likeness is the containment
of the smaller sketch in the larger one.

The next document comes from a range bucketing by doc_id: bucket bounds are ids that occur, and the document at a bound
is sent to the bucket before it as well (the first one to the last, for the wrap), so one shuffle of the texts is all.

Defined cases: a null text is empty; an empty text has an empty sketch; two empty sketches are alike (1), one empty and
one other are not (0); a null doc_id sorts first; equal doc_ids sort by text; a lone document follows itself; other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHINGLE_WORDS = 5
#: Share of the hash range that is kept.
FRACTION = 1 / 4
#: Documents in a range bucket, and the most buckets that bounds (a literal in the plan) are made for; with more documents
#: than both allow, buckets hold more and are sorted with spills, with the same results.
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16
#: Buckets in a task of the one shuffle, at most: its tasks grow in number with the table.
TASK_BUCKETS = 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def threshold(fraction: float = FRACTION) -> int:
    return int(-(1 << 63) + fraction * (1 << 64))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the shingles of both texts, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda h: h < threshold(fraction))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def sketch(text: Column, size: int = SHINGLE_WORDS, fraction: float = FRACTION) -> Column:
    """Sorted distinct shingle hashes below the threshold, or the smallest one; empty without words."""
    limit = threshold(fraction)

    def of(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - size + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.get(ws, i + (k - 1)) for k in range(size)]))

    def kept(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: h < limit)
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(hashes)))

    # a one-element transform names a value once, so that it is computed once
    found = F.transform(F.array(words(text)), lambda ws: F.when(F.size(ws) > 0, of(ws)).otherwise(F.array().cast("array<bigint>")))
    return F.transform(found, lambda hs: F.when(F.size(hs) > 0, kept(hs)).otherwise(hs))[0]


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds."""
    least = F.least(F.size(a), F.size(b))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def _slot(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at or below key, by binary search."""
    array = _longs(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.coalesce(F.get(array, at + step - 1), F.lit((1 << 63) - 1)) <= key), at + step).otherwise(at),
    )


def _longs(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _existing(ids: DataFrame, cuts: list[int]) -> list[int]:
    """The least key and the least one at or above each cut: quantiles are doubles, which keys beyond 2**53 need not be."""
    cuts = [c for c in cuts if -(1 << 63) <= c < 1 << 63]
    slot = _slot(F.col("key"), cuts) if cuts else F.lit(0)
    return sorted(r[0] for r in ids.groupBy(slot.alias("slot")).agg(F.min("key")).select("min(key)").collect())


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text and sketch of every row, next_text and next_sketch of the row after it by doc_id (after the last: the first)."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    n = rows.select("key").count()
    count = max(1, min(MOST_BUCKETS, n // bucket_rows))
    ids = rows.select("key")
    cuts = sorted({int(r) for r in ids.approxQuantile("key", [k / count for k in range(1, count)], 0.2 / count)} if count > 1 and n else set())
    bounds = _existing(ids, cuts) or [0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-len(bounds) // TASK_BUCKETS))
    array = _longs(bounds)
    bucket = _slot(F.col("key"), bounds)
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("lap"), F.lit(False).alias("ghost"))
    before = F.struct(
        F.when(F.col("bucket") == 1, F.lit(len(bounds))).otherwise(F.col("bucket") - 1).alias("bucket"),
        F.when(F.col("bucket") == 1, F.lit(1)).otherwise(F.lit(0)).alias("lap"),
        F.lit(True).alias("ghost"),
    )
    at_bound = F.get(array, F.col("bucket") - 1) == F.col("key")
    placed = rows.withColumn("bucket", bucket).withColumn("place", F.explode(F.when(at_bound, F.array(here, before)).otherwise(F.array(here))))
    placed = placed.select("doc_id", "text", "key", "place.*").repartition(tasks, "bucket").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("lap", "key", "text")
    return placed.select(
        "doc_id", "text", "sketch", "ghost", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch")
    ).filter(~F.col("ghost"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and that to the next document."""
    found = with_next(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter))
    found = found.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
