"""Chat formatting by quotation linking.

Messages are split into own text and quoted passages by their leading '>' marks, one level a mark. Quoted passages are
normalised (blanks collapsed, lower-cased) and hashed whole, by paragraph and by line, and joined by hash, within a
conversation, to the earlier messages that own such a piece: a whole own text, a run of own lines between quotes, or a
paragraph or line of these. A passage is of the latest owner of its longest piece that has one, so that a part of a text,
or more than it, links too. An owner counts if what it owns of the passage, its longest piece or its lines together, is at least half of the passage or
MIN_PIECE characters, so that greetings and signatures within a longer quote of something else name nobody. A message replies to the latest of those that its least nested linked passages name. A conversation is then ordered by threads: each message without a reply target, in
turn order, followed by all that answer it, directly or not, in turn order; texts come without quotes.

Defined cases: a null or empty text has no passages; a null conv_id or turn links to nothing; equal turns of a conversation are
told apart and ordered by role and a hash of the row; repeated rows link alike and keep their number; an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, by_batch, table, written

#: Characters (blanks aside) of a passage that suffice to name their owner, however long the passage is.
MIN_PIECE = 80

_MARKS = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?")
PARSED = "conv_id bigint, turn bigint, role string, row_key bigint, body string, quotes array<struct<level:int,passage:bigint,hash:bigint,size:int,line:boolean,whole:int>>, n_quotes bigint, owned array<bigint>"


def _plain(text: str) -> str:
    return " ".join(text.split()).lower()


def _length(text: str) -> int:
    """Characters that are no blanks."""
    return sum(map(len, text.split()))


def passage_hash(text: str) -> int | None:
    """A 64-bit hash of a passage, blanks collapsed and lower-cased; None if nothing is left."""
    plain = _plain(text)
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) if plain else None


def _runs(text: str) -> list[tuple[int, str]]:
    """Each run of lines of one quote level (0: own text) as (level, lines without marks)."""
    lines = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        lines.append((marks.group(1).count(">"), line[marks.end() :]) if marks else (0, line))
    return [(level, "\n".join(rest for _, rest in run)) for level, run in groupby(lines, key=lambda x: x[0])]


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and each run of lines of one quote level as (level, passage)."""
    runs = _runs(text)
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(t for level, t in runs if not level)).strip("\n")
    return body, [(level, t) for level, t in runs if level]


def _parts(text: str) -> list[str]:
    """A text, its paragraphs and its lines."""
    return [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]


def owned_hashes(body: str, runs: Iterable[str] = ()) -> set[int]:
    """Hashes of the whole own text, of each run of own lines between quotes, and of their paragraphs and lines."""
    parts = {p for t in (body, *runs) for p in _parts(t)}
    return {h for h in map(passage_hash, parts) if h is not None}


def quoted_pieces(quotes: list[tuple[int, str]]) -> list[dict[str, int]]:
    """Each quoted passage, and its paragraphs and lines: level, hash and length of the passage, hash and length of the piece, and whether it is a line."""
    out = {}
    for level, passage in quotes:
        whole, lines = passage_hash(passage), {passage_hash(x) for x in passage.split("\n")}
        for part in _parts(passage):
            h = passage_hash(part)
            if h is not None:
                out[level, whole, h] = {"size": _length(part), "line": h in lines, "whole": _length(passage)}
    return [{"level": level, "passage": whole, "hash": h, **sizes} for (level, whole, h), sizes in out.items()]


def parse(messages: DataFrame) -> DataFrame:
    bounded_batches(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("conv_id", "turn", F.coalesce("role", F.lit("")), "text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies, quotes, counts, owned = [], [], [], []
        for text in batch.column("text").to_pylist():
            body, found = split_quotes(text)
            bodies.append(body)
            quotes.append(quoted_pieces(found))
            counts.append(sum(passage_hash(t) is not None for _, t in found))
            owned.append(sorted(owned_hashes(body, [t for level, t in _runs(text) if not level] if found else ())))
        kept = [batch.column(c) for c in ("conv_id", "turn", "role", "row_key")]
        quote = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("line", pa.bool_()), ("whole", pa.int32())]))
        made = [pa.array(bodies, pa.string()), pa.array(quotes, quote), pa.array(counts, pa.int64()), pa.array(owned, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*kept, *made], ["conv_id", "turn", "role", "row_key", "body", "quotes", "n_quotes", "owned"])

    return rows.mapInArrow(by_batch(run), PARSED)


def reply_links(parsed: DataFrame) -> DataFrame:
    """conv_id, row_key, parent_key, parent_turn and n_linked of every message that quotes an earlier one."""
    parsed = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = parsed.filter(F.size("quotes") > 0).select("conv_id", "turn", "row_key", F.explode("quotes").alias("q"))
    quoting = quoting.select("conv_id", "turn", "row_key", "q.*").distinct()
    wanted = quoting.select("conv_id", "hash").distinct()
    # only pieces that someone quotes are kept, so that the join is of quoted text, not of all text
    owned = parsed.select("conv_id", F.col("turn").alias("o_turn"), F.col("row_key").alias("o_key"), F.explode("owned").alias("hash"))
    owned = owned.join(wanted, ["conv_id", "hash"], "left_semi").distinct()
    # the latest earlier owner of each quoted piece, by one pass over owners and quotes in turn order
    both = owned.select("conv_id", "hash", F.col("o_turn").alias("turn"), "o_key").unionByName(quoting, allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    owner = F.max(F.when(F.col("o_key").isNotNull(), F.struct("turn", "o_key"))).over(earlier)
    found = both.withColumn("owner", owner).filter(F.col("row_key").isNotNull() & F.col("owner").isNotNull())
    passage = ("conv_id", "row_key", "level", "passage")
    held = found.groupBy(*passage, "whole", "owner").agg(F.max("size").alias("size"), F.sum(F.when(F.col("line"), F.col("size"))).alias("lines"))
    held = held.filter(F.greatest("size", "lines") >= F.least(F.lit(MIN_PIECE), F.col("whole") / 2))
    longest = F.max_by("owner", F.struct("size", "owner.turn", "owner.o_key"))
    found = held.groupBy(*passage).agg(longest.alias("owner"))
    best = F.max_by("owner", F.struct(-F.col("level"), F.col("owner.turn"), F.col("owner.o_key")))
    return found.groupBy("conv_id", "row_key").agg(best.alias("best"), F.countDistinct("passage").alias("n_linked")).select(
        "conv_id", "row_key", F.col("best.o_key").alias("parent_key"), F.col("best.turn").alias("parent_turn"), "n_linked"
    )


def thread_roots(links: DataFrame) -> DataFrame:
    """conv_id, row_key, root_key and root_turn of every message with a parent (keys hold within conv_id, if links have it), by pointer jumping: each round halves the way left.

    Parents are earlier than their replies, so n links need log2(n) rounds at most; were two rows to share a key and make a
    ring, it would end there too.
    """
    conv = [c for c in links.columns if c == "conv_id"]
    roots = links.select(*conv, "row_key", F.col("parent_key").alias("root_key"), F.col("parent_turn").alias("root_turn"))
    for _ in range(links.count().bit_length() + 1):
        up = roots.select(*conv, F.col("row_key").alias("root_key"), F.col("root_key").alias("up_key"), F.col("root_turn").alias("up_turn"))
        jumped = written(
            roots.join(up, [*conv, "root_key"], "left").select(
                *conv, "row_key", F.coalesce("up_key", "root_key").alias("root_key"), F.coalesce("up_turn", "root_turn").alias("root_turn"), F.col("up_key").isNotNull().alias("moved")
            ),
            "threads",
        )
        roots = jumped.drop("moved")
        if not jumped.filter("moved").take(1):
            break
    return roots


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every message without quotes: its reply target, its thread's first turn and its place in the conversation."""
    parsed = written(parse(messages), "messages")
    links = written(reply_links(parsed), "reply-links")
    roots = thread_roots(links)
    joined = parsed.join(links, ["conv_id", "row_key"], "left").join(roots, ["conv_id", "row_key"], "left")
    ordered = joined.select(
        "conv_id",
        "turn",
        "role",
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("thread_turn"),
        F.coalesce("root_key", "row_key").alias("thread_key"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.col("body").alias("text"),
        "row_key",
    )
    keys = ["conv_id", "thread_turn", "thread_key", "turn", "role", "row_key"]
    return numbered(ordered, keys).drop("thread_key", "row_key")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with position, their place within the first key in the order of all keys; a group may span many tasks.

    Rows are dealt and sorted by range, numbered within their task, and moved on by the counts of the tasks before.
    """
    group = keys[0]
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for value in batch.column(group).to_pylist():
                place = place + 1 if value == last else 1
                last = value
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], [*batch.schema.names, "part", "place"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "numbered")
    counts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("__group"), F.col("part").alias("__part"), F.coalesce(before, F.lit(0)).alias("__before"))
    both = placed.join(counts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("part") == F.col("__part")))
    return both.withColumn("position", F.col("place") + F.col("__before")).drop("__group", "__part", "__before", "part", "place")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


QUERIES = {"op3_quotation_linking": op3_quotation_linking}
