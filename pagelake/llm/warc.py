"""WARC archives with a two-level capture index.

Records are gzip members of archive files in shared storage. The index has an entry per capture, keyed by the URL with
its host reversed, sorted and cut into compressed blocks; every index file has a sparse directory of its blocks' first
keys, and the list of index files (as many as there were tasks, at most MOST_FILES) is the level above. A lookup binary-
searches the files, the directory and the block, then reads the record's range.

Defined cases: a null page has an empty payload; a null URL has the empty key; payloads under REVISIT_BYTES bytes are
always responses; of equal larger ones the rows with the smallest page_id are responses (a null page_id is never the
smallest; without any other, all are responses); repeated rows are written each; an empty table writes nothing and gives
no row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, table, written

REVISIT_BYTES = 100
BLOCK_ENTRIES = 2000
#: Index files; their first keys go to every task.
MOST_FILES = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ENTRIES = "key string, page_id bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it; s3a and s3n are Hadoop's names of s3."""
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if colon and scheme in ("s3a", "s3n") else uri)


def surt(url: str | None) -> str:
    """The URL with its scheme cut off and its host lower-cased and reversed, as com,example,www)/path."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0]


def entry_key(url: str | None, page_id: int | None, digest: str) -> str:
    return f"{surt(url)} {'-' if page_id is None else format(page_id + (1 << 63), '020d')} {digest}"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload where refers_to is given; one gzip member."""
    body = HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> dict:
    """The fields of RECORDS out of a record; a response's digest and length are taken from its payload itself."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    kind = fields["WARC-Type"]
    number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn not in (None, "<urn:page:>") else None
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": len(payload) if kind == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
    }


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses) of every page.

    A digest that a third of all pages share is a hot key of narrow rows only; payloads join on page and digest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("digest", "page_id")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    later = narrow.distinct().join(first, "digest").filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    same = F.col("r.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("r.digest") == F.col("l.digest"))
    return rows.alias("r").join(later.alias("l"), same, "left").select("r.page_id", "url", "payload", "r.digest", F.col("first").alias("refers_to"))


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        offset = 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None:  # a new name each attempt: what a lost task wrote is never referred to
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    store, path = _opened(folder)
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(data)
                rows.append({"key": entry_key(row["url"], row["page_id"], row["digest"]), "page_id": row["page_id"], "file": name, "offset": offset, "length": len(data)})
                offset += len(data)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page's record under folder; the captures' index entries, as a table in the shared folder."""
    bounded_batches(pages.sparkSession)
    return written(roles(pages).mapInArrow(_archive(folder), ENTRIES), "captures")


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, uuid.uuid4().hex, 0
        block: list[list] = []
        directory: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal offset
            data = zlib.compress(json.dumps(block).encode(), 6)
            out.write(data)
            directory.append((block[0][0], offset, len(data)))
            offset += len(data)
            block.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, path = _opened(folder)
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}.blocks")
                block.append([row["key"], row["file"], row["offset"], row["length"]])
                if len(block) >= BLOCK_ENTRIES:
                    close()
        if out is not None:
            if block:
                close()
            out.close()
            with store.open_output_stream(f"{path}/{name}.directory") as listing:
                listing.write(zlib.compress(json.dumps(directory).encode(), 6))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first_key", "file"])

    return run


def write_index(entries: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Writes the sorted blocks and their directories; the index files' first keys (at most MOST_FILES) and names."""
    spark = entries.sparkSession
    files = min(MOST_FILES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = entries.repartitionByRange(files, "key").sortWithinPartitions("key")
    return sorted((r["first_key"], r["file"]) for r in ordered.mapInArrow(_index(folder), "first_key string, file string").collect())


class Captures:
    """Lookups in an index: each opened file, directory and the last block are kept."""

    def __init__(self, folder: str, files: list[tuple[str, str]]):
        self.store, self.folder = _opened(folder)
        self.first, self.names = [k for k, _ in files], [n for _, n in files]
        self.handles: dict[str, pa.NativeFile] = {}
        self.directories: dict[str, tuple[list[str], list]] = {}
        self.block: tuple[tuple, list[str], list] | None = None

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.handles:
            if len(self.handles) > 100:
                self.handles.pop(next(iter(self.handles))).close()
            self.handles[file] = self.store.open_input_file(f"{self.folder}/{file}")
        return self.handles[file].read_at(length, offset)

    def find(self, key: str) -> tuple[str, int, int] | None:
        """Where the record of an entry key is."""
        at = bisect.bisect_right(self.first, key) - 1
        if at < 0:
            return None
        name = self.names[at]
        if name not in self.directories:
            if len(self.directories) > 20:
                self.directories.clear()
            with self.store.open_input_file(f"{self.folder}/{name}.directory") as listing:
                rows = json.loads(zlib.decompress(listing.read()))
            self.directories[name] = ([r[0] for r in rows], rows)
        keys, rows = self.directories[name]
        _, offset, length = rows[bisect.bisect_right(keys, key) - 1]
        if self.block is None or self.block[0] != (name, offset):
            entries = json.loads(zlib.decompress(self.read(f"{name}.blocks", offset, length)))
            self.block = ((name, offset), [e[0] for e in entries], entries)
        at = bisect.bisect_left(self.block[1], key)
        if at == len(self.block[1]) or self.block[1][at] != key:
            return None
        return tuple(self.block[2][at][1:])

    def get(self, key: str) -> dict | None:
        place = self.find(key)
        return None if place is None else parsed(self.read(*place))


def lookup(keys: DataFrame, folder: str, files: list[tuple[str, str]]) -> DataFrame:
    """The records of the entry keys (a column key), read back; keys in range order, so that a block is read once in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures = None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            captures = captures or Captures(folder, files)
            found = [captures.get(k) for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_pylist([f for f in found if f], schema)

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("key").repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    entries = write_archives(table(spark, sf_dir, "pages"), folder)
    files = write_index(entries, folder)
    return lookup(entries, folder, files).drop("url")


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {
    "op7_warc": f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest
)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN first IS NOT NULL AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
}
