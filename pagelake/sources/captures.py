"""A data source for captured traffic: read_captures(spark, path), and spark.readStream.format("captures") for streams.

Captures lie as JSON lines under <path>/batch=<number>/host=<host>/; a batch counts once its folder holds Spark's mark of success. A file is
read in pieces of at most `split` bytes, cut at line ends. Filters on host (=, in, is null, ends with) and on batch (=, >=) are pushed down, so that only
the files of such hosts and batches become partitions. A stream's offset is the number of the next batch to read.

read_captures() always filters on batch. Spark 4.1 keeps the last pushed filters with a relation and plans a later query that pushes none with
them, so a relation of spark.read.format("captures") that is used twice, first with such a filter and then without any, would lose rows.

Paths are read through pyarrow's file systems, by every task itself. A line that is no JSON object is a row of nulls beside its host.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, StringEndsWith

from ..functions import urls
from .tables import HAR_ENTRY

SPLIT = 32 << 20
CAPTURE = f"host string, batch bigint, {HAR_ENTRY}"
#: How Spark names the partition of a null host.
NO_HOST = "__HIVE_DEFAULT_PARTITION__"


def write_captures(entries: DataFrame, path: str, batch: int) -> None:
    """entries as one batch; it is seen once all of it is written."""
    entries.withColumn("host", urls.hostname(F.col("url"))).write.partitionBy("host").json(f"{path.rstrip('/')}/batch={batch:012d}")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Python sources push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def read_captures(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """All entries of whole batches, with host and batch."""
    register(spark)
    return spark.read.format("captures").option("split", split).load(path).filter("batch >= 0")


def _file_system(path: str):
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    if colon and scheme in ("s3a", "s3n"):  # Hadoop's names of the same store
        path = f"s3://{rest}"
    if not colon and path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class Piece(InputPartition):
    """The lines of a file that begin in [start, end)."""

    def __init__(self, path: str, host: str | None, batch: int, start: int, end: int):
        self.path, self.host, self.batch, self.start, self.end = path, host, batch, start, end


def _batches(path: str) -> list[int]:
    """Numbers of the whole batches, in order."""
    from pyarrow import fs

    system, root = _file_system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    named = [f for f in found if f.base_name.startswith("batch=") and f.base_name[6:].isdigit()]
    return sorted(int(f.base_name[6:]) for f in named if system.get_file_info(f"{f.path}/_SUCCESS").type != fs.FileType.NotFound)


def _pieces(path: str, batches: Iterable[int], wanted, split: int) -> list[Piece]:
    from pyarrow import fs

    system, root = _file_system(path)
    out = []
    for batch in batches:
        for folder in system.get_file_info(fs.FileSelector(f"{root}/batch={batch:012d}")):
            if not folder.base_name.startswith("host="):
                continue
            name = unquote(folder.base_name[5:])
            host = None if name == NO_HOST else name
            if not wanted(host):
                continue
            for file in system.get_file_info(fs.FileSelector(folder.path)):
                if file.base_name[0] not in "._":
                    out += [Piece(file.path, host, batch, at, min(at + split, file.size)) for at in range(0, file.size, split)]
    return sorted(out, key=lambda p: (p.path, p.start))


def _lines(path: str, piece: Piece) -> Iterator[bytes]:
    """The lines of a piece; one that crosses its end is its own, one that crosses its start is the piece's before."""
    system, _ = _file_system(path)
    with system.open_input_file(piece.path) as file:
        at = max(piece.start - 1, 0)
        file.seek(at)
        rest, first = b"", piece.start > 0
        while True:
            block = file.read(1 << 20)
            *lines, rest = (rest + block).split(b"\n") if block else ([rest, b""] if rest else [b""])
            for line in lines:
                if at >= piece.end:
                    return
                at += len(line) + 1
                if not first and line:
                    yield line
                first = False
            if not block:
                return


class _Reading:
    """What both readers share; they are sent to tasks."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def read(self, partition: Piece | None) -> Iterator[tuple]:
        if partition is None:  # there are no partitions at all
            return
        names = [f.split()[0] for f in HAR_ENTRY.split(", ")]
        for line in _lines(self.path, partition):
            try:
                row = json.loads(line)
            except ValueError:
                row = None
            row = row if isinstance(row, dict) else {}
            yield (partition.host, partition.batch, *[row.get(n) for n in names])


class CaptureReader(_Reading, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        on_host, on_batch = (EqualTo, In, IsNull, IsNotNull, StringEndsWith), (EqualTo, GreaterThanOrEqual)
        for f in filters:
            if isinstance(f, on_host if f.attribute == ("host",) else on_batch if f.attribute == ("batch",) else ()):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, name: str, value: str | int | None) -> bool:
        """Whether the pushed filters on a column let a value pass."""

        def fits(f: Filter) -> bool:
            if isinstance(f, (IsNull, IsNotNull)) or value is None:
                return (value is None) == isinstance(f, IsNull)
            if isinstance(f, StringEndsWith):
                return value.endswith(f.value)
            if isinstance(f, GreaterThanOrEqual):
                return value >= f.value
            return value == f.value if isinstance(f, EqualTo) else value in f.value

        return all(fits(f) for f in self.filters if f.attribute == (name,))

    def partitions(self) -> list[Piece]:
        batches = [b for b in _batches(self.path) if self.wanted("batch", b)]
        return _pieces(self.path, batches, lambda host: self.wanted("host", host), self.split)


class CaptureStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        whole = _batches(self.path)
        return {"batch": whole[-1] + 1 if whole else 0}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _pieces(self.path, [b for b in _batches(self.path) if start["batch"] <= b < end["batch"]], lambda host: True, self.split)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURE

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)
