"""Prefix trie of conversations, family by family.

A family is the conversations of one base id: each starts with some first turns of its base conversation. Conversations meet
the head of their base by base id, are rebuilt, and each family's small trie is built first: one row for each prefix of the
family, with its members counted. Only those combined family nodes move on to be merged into the trie of all families.

No family and no conversation is held by a task. Turns are dealt by range of (conversation, turn), so a long conversation spans
many tasks; places, prefix keys and word sums are running aggregates within a task, carried over from the tasks before. The key of a
prefix is the XOR of two 64-bit hashes of (place, 128-bit digest of the turn), so a key is made without the turns before it; two
different prefixes of n share a key with odds of n * n / 2**129.

Sums over a subtree need no walk. With each node given to its smallest member, the nodes of a member are the end of its path; so a
node's leaves, and the words of its subtree's nodes, are sums over its members of what each member owns below it.

Defined cases: turns are ordered by turn, null first, ties by the SHA-256 of role and text; repeated turns count as often as they
stand; a null role or text is empty; turns of a null conversation belong to none and are left out; other columns are ignored; an
empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .branches import crc32_sql
from .common import bounded_batches, table, written

#: Ids of a family, and the number of first turns that a conversation may take from its base (one less than this at most).
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
KEY = ("depth", "k1", "k2")
#: Bytes of joined ids that one row holds before their hash is taken.
CHUNK = 1 << 16


def _salted(depth: Column, digest: Column) -> list[Column]:
    """Two hashes of a turn at its depth."""
    return [F.xxhash64(depth.cast("bigint"), digest).alias("s1"), F.xxhash64(F.lit(2), digest, depth.cast("bigint")).alias("s2")]


def turns(convs: DataFrame) -> DataFrame:
    """Narrow turns: their text is a digest and a number of words from here on."""
    conv, text = F.col("conv_id").cast("bigint"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256)
    return convs.filter("conv_id is not null").select(
        conv.alias("conv_id"), (conv - conv % FAMILY).alias("base"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("digest"), F.regexp_count(text("text"), F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("tie")
    )


def rebuilt(convs: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: conv_id, base, its key and its parent's (p1, p2), words of its last turn, words from
    there to the end (below), and whether the conversation ends there (last)."""
    order = ("turn", "digest", "tie")
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(turns(convs).repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    own = Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))

    # the base's first turns meet its family
    place = F.row_number().over(Window.partitionBy("base").orderBy(*order))
    heads = dealt.filter("conv_id = base").select("base", "digest", "words", place.alias("place")).filter(F.col("place") < HEADS)
    heads = heads.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("heads"))
    spans = written(dealt.groupBy("part", "conv_id", "base").agg(F.count(F.lit(1)).alias("n")), "spans")
    met = spans.groupBy("conv_id", "base").agg(F.sum("n").alias("n")).join(heads, "base", "left")
    met = met.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int"))
    head = F.when(F.col("heads").isNull() | (F.col("h") == 0), F.array().cast("array<struct<s1:bigint,s2:bigint,words:bigint>>")).otherwise(
        F.transform(F.slice("heads", 1, F.greatest("h", F.lit(1))), lambda x: F.struct(*_salted(x["place"], x["digest"]), x["words"].alias("words")))
    )
    met = met.select("conv_id", "base", "n", "h", head.alias("head")).withColumn("k", F.size("head"))
    upto = lambda name, n, join: F.aggregate(F.slice("head", 1, n), F.lit(0).cast("bigint"), lambda a, x: join(a, x[name]))
    xor, plus = lambda a, b: a.bitwiseXOR(b), lambda a, b: a + b
    met = written(met.select("*", *[upto(s, F.col("k"), xor).alias(f"h{s}") for s in ("s1", "s2")], upto("words", F.col("k"), plus).alias("h_words")), "families")

    # its own turns after them: places, then prefix keys, each carried over tasks
    info = spans.select("part", "conv_id", zero(F.sum("n").over(earlier)).alias("before")).join(met.select("conv_id", "n", "h", "k"), "conv_id")
    tails = dealt.withColumn("at", F.row_number().over(own)).join(info, ["part", "conv_id"]).withColumn("place", F.col("at") + F.col("before")).filter("place > h")
    tails = tails.withColumn("depth", (F.col("place") - F.col("h") + F.col("k")).cast("bigint")).withColumn("last", F.col("place") == F.col("n"))
    tails = tails.select("part", "conv_id", "base", *order, "depth", "words", "last", *_salted(F.col("depth"), F.col("digest")))
    running = [F.bit_xor("s1").over(own).alias("x1"), F.bit_xor("s2").over(own).alias("x2"), F.sum("words").over(own).alias("through")]
    tails = written(tails.select("*", *running).drop(*order), "tails")
    sums = tails.groupBy("part", "conv_id").agg(F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"), F.sum("words").alias("w"))
    carried = [zero(F.bit_xor(c).over(earlier)).alias(c) for c in ("x1", "x2")] + [zero(F.sum("w").over(earlier)).alias("w"), F.sum("w").over(Window.partitionBy("conv_id")).alias("w_all")]
    carry = sums.select("part", "conv_id", *carried).join(met.select("conv_id", "hs1", "hs2", "h_words"), "conv_id")
    carry = carry.select("part", "conv_id", *[F.col(x).bitwiseXOR(F.col(f"hs{x[1]}")).alias(f"c{x[1]}") for x in ("x1", "x2")], (F.col("w_all") - F.col("w")).alias("left"), "w_all")
    key = [F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")) for k in (1, 2)]
    tail_rows = tails.join(carry.drop("w_all"), ["part", "conv_id"]).select(
        "conv_id", "base", "depth", *[x.alias(f"k{k}") for k, x in enumerate(key, 1)], *[x.bitwiseXOR(F.col(f"s{k}")).alias(f"p{k}") for k, x in enumerate(key, 1)],
        "words", (F.col("left") - F.col("through") + F.col("words")).alias("below"), "last",
    )
    totals = carry.select("conv_id", "w_all").groupBy("conv_id").agg(F.max("w_all").alias("w_all"))
    d = F.col("d")
    at = lambda name: F.when(d > 0, F.get("head", d - 1)[name])
    keys = {s: upto(s, d, xor) for s in ("s1", "s2")}
    head_rows = met.join(totals, "conv_id", "left").select("*", F.explode(F.sequence(F.lit(0), "k")).alias("d")).select(
        "conv_id", "base", d.cast("bigint").alias("depth"), *[keys[f"s{k}"].alias(f"k{k}") for k in (1, 2)], *[keys[f"s{k}"].bitwiseXOR(at(f"s{k}")).alias(f"p{k}") for k in (1, 2)], zero(at("words")).alias("words"),
        (zero(F.col("w_all")) + F.col("h_words") - upto("words", d, plus) + zero(at("words"))).alias("below"), ((d == F.col("k")) & (F.col("n") <= F.col("h"))).alias("last"),
    )
    return tail_rows.unionByName(head_rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and base: the ids of each run of one node in fewer, longer rows."""
    for batch in batches:
        out: list[list] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if out and tuple(out[-1][:3]) == row[:3] and len(out[-1][4]) < CHUNK:
                out[-1][4] += "," + row[4]
            else:
                out.append(list(row))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), batch.schema.types)], batch.schema.names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and base: the hash of all ids of each node; only its state is held."""
    last, state = None, hashlib.sha256()
    made = lambda rows: pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*rows))[:3]], pa.array([r[3] for r in rows], pa.string())], [*KEY, "ends_sha256"])
    for batch in batches:
        out = []
        for *key, _, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if out:
            yield made(out)
    if last is not None:
        yield made([(*last, state.hexdigest())])


def ends_digests(family: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end in each node. Families are disjoint ranges of ids, so their lists follow each other by base."""
    bounded_batches(family.sparkSession)
    parts = int(family.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = family.filter("ends <> ''").select(*KEY, "base", "ends")
    joined = rows.repartitionByRange(parts, *KEY, "base").sortWithinPartitions(*KEY, "base").mapInArrow(_joined, rows.schema)
    return joined.repartition(parts, *KEY).sortWithinPartitions(*KEY, "base").mapInArrow(_hashed, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations; conv_id (smallest member) and depth name a node."""
    path = written(rebuilt(convs), "prefixes")
    ends = F.array_join(F.array_sort(F.collect_list(F.when(F.col("last"), F.col("conv_id")))), ",")
    fixed = [F.first(c).alias(c) for c in ("p1", "p2", "words")]
    family = path.groupBy("base", *KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *fixed, F.sum("below").alias("below"), ends.alias("ends"))
    family = written(family, "family-nodes")
    nodes = family.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *fixed, F.sum("below").alias("below"))
    nodes = written(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = written(nodes.join(children, list(KEY), "left").join(parents, ["depth", "p1", "p2"], "left"), "linked-nodes")
    # what each conversation owns: the nodes whose smallest member it is, the end of its path
    owned = linked.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max(F.col("n_children").isNull().cast("bigint")).alias("leaf"), F.sum("words").alias("owned"))
    share = F.when(F.col("depth") >= F.col("first"), F.col("below")).otherwise(F.col("owned"))
    shares = path.join(owned, "conv_id").groupBy("base", *KEY).agg(F.sum("leaf").alias("leaf"), F.sum(share).alias("share"))
    shares = shares.groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("share").alias("share"))
    whole = linked.join(shares, list(KEY), "left").join(ends_digests(family), list(KEY), "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves", (F.col("below") - F.col("share")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL = {
    "op12_prefix_trie": f"""
WITH o AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT conv_id, list(x ORDER BY pos) AS xs, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM o GROUP BY conv_id),
r AS (SELECT a.conv_id, list_concat(coalesce(b.xs[1:a.h], []), a.xs[a.h + 1:]) AS xs FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
p AS (SELECT conv_id, xs[1:d] AS key, d AS depth, len(xs) = d AS ends FROM (SELECT *, unnest(generate_series(0, len(xs))) AS d FROM r)),
n AS MATERIALIZED (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth > 0 THEN len(regexp_extract_all(key[depth].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key, depth
), k AS MATERIALIZED (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT key[1:d] AS key, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM (SELECT n.*, k.n_children, unnest(generate_series(0, depth)) AS d FROM n LEFT JOIN k ON n.key = k.key) GROUP BY 1
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON n.key = s.key LEFT JOIN k ON n.key = k.key LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.key = n.key[1:n.depth - 1]"""
}
