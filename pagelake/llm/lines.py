"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host when more than RATIO of the host's pages contain it and at least MIN_PAGES do, where pages
with the same lines count as one: copies do not make their content boilerplate. A host's
boilerplate has at most (lines of a page) / RATIO entries on average, however many pages there are, so it is gathered
per host. It is broadcast if all hosts' entries together are at most BROADCAST_LINES; else pages and hosts join on host
and salt, so that a host with a third of all pages is spread over SALTS tasks.

Defined cases: a null text is empty and stays null; a null host is the empty host; lines are compared trimmed of blanks, blank
lines are never boilerplate; a line counts once for a page, and pages of a host that have the same lines in the same
order (blank ones and repetitions aside) are one page; an empty table gives no row; columns other than text (and n_chars, which follows it) pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, table, written

RATIO, MIN_PAGES = 0.05, 10
#: Line hashes (8 bytes each) that may be broadcast; keys that a host is spread over beyond that.
BROADCAST_LINES, SALTS = 500_000, 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and the hashes of its boilerplate lines; hosts without any are left out."""
    rows = pages.select(_host(host).alias("host"), F.col(text).cast("string").alias("text"))
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    texts = rows.select("host", distinct.alias("lines")).distinct()
    totals = texts.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") >= min_pages).join(totals, "host").filter(F.col("n") > F.col("pages") * ratio)
    return found.groupBy("host").agg(F.collect_set("line").alias("lines"))


def _marked(pages: DataFrame, host: str, text: str, broadcast_lines: int, **limits) -> tuple[DataFrame, str, str]:
    """pages with two columns more, and their names: all lines, and those that are not their host's boilerplate."""
    owner, drops, key, part, salt, lines, kept = free_names(pages, "__host", "__drop", "__key", "__part", "__salt", "__lines", "__kept")
    drop = written(boilerplate(pages, host, text, **limits).select(F.col("host").alias(owner), F.col("lines").alias(drops)), "boilerplate")
    rows = pages.withColumn(key, _host(host))
    entries = drop.agg(F.sum(F.size(drops) + F.octet_length(owner) / 8)).first()[0] or 0
    if entries <= broadcast_lines:
        joined = rows.join(F.broadcast(drop), F.col(key) == F.col(owner), "left")
    else:
        drop = drop.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = rows.join(drop, (F.col(key) == F.col(owner)) & (F.col(salt) == F.col(part)), "left").drop(part, salt)
    joined = joined.withColumn(lines, _lines(F.col(text).cast("string")))
    own = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(drops, _key(x)))
    return joined.withColumn(kept, F.when(F.col(drops).isNull(), F.col(lines)).otherwise(own)).drop(owner, drops, key), lines, kept


def mark_lines(pages: DataFrame, host: str, text: str = "text", broadcast_lines: int = BROADCAST_LINES, **limits) -> DataFrame:
    """pages with __lines (all lines) and __kept (those that are not their host's boilerplate); where pages has a column of
    such a name, the new one has an underscore more."""
    return _marked(pages, host, text, broadcast_lines, **limits)[0]


def drop_lines(docs: DataFrame, host: str = "source", broadcast_lines: int = BROADCAST_LINES, **limits) -> DataFrame:
    """docs without boilerplate lines; its columns, n_chars (if it has one) counted again for changed texts."""
    marked, lines, kept = _marked(docs, host, "text", broadcast_lines, **limits)
    changed = F.size(kept) < F.size(lines)
    out = marked.withColumn("text", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = F.array_join("__kept", "\n")
    return mark_lines(docs, "source").select(
        "doc_id",
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("bigint").alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {
    "op10_line_dedup": f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS host, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), page AS (
  SELECT DISTINCT host, list_filter(own, lambda x, i: list_position(own, x) = i) AS own
  FROM (SELECT host, list_filter(list_transform(lines, lambda x: trim(x, ' ')), lambda x: x <> '') AS own FROM l)
), total AS (
  SELECT host, count(*) AS pages FROM page GROUP BY host
), seen AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(own) AS line FROM page) GROUP BY host, line
), boiler AS (
  SELECT host, list(line) AS lines FROM seen JOIN total USING (host)
  WHERE pages >= {MIN_PAGES} AND n >= {MIN_PAGES} AND n > pages * {RATIO} GROUP BY host
), kept AS (
  SELECT doc_id, l.lines, list_filter(l.lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(b.lines, []), trim(x, ' '))) AS k
  FROM l LEFT JOIN boiler b USING (host)
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(k) AS BIGINT) AS n_dropped,
  sha256(array_to_string(k, chr(10))) AS kept_sha256 FROM kept"""
}
