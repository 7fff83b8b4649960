"""Landed text with many records per file, as a stream.

A Spark Python data source. The stream's offset is a place in the sequence of
landed files, ordered by file time and path: so many files are done, and so many
bytes of the next. A micro-batch reads the bytes between two offsets, cut into
splits of bounded size; a record belongs to the split in which it starts, and is
read whole even where it runs on into the next, so neither the borders of splits nor
those of micro-batches (``maxBytesPerTrigger``) lose or repeat one. A restarted
query goes on from the offset in its checkpoint, in the middle of a file if it
ended there.

``seq`` is the number of the file and the byte the record starts at in one number, so
it has the order of ``landed.read_records`` without any state. Files are read
through ``pyarrow.fs`` (a path or URI), whole as they landed: a file must not
change any more, and a new one must not be older than those already read.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: bits of seq for the byte in a file
FILE_BITS = 36
SPLIT_BYTES = 64 << 20
_READ = 1 << 20
_ROWS = 2000


@dataclass
class Split(InputPartition):
    path: str
    number: int
    micros: int
    begin: int
    end: int


def records(source, size: int, begin: int, end: int, separator: bytes) -> Iterator[tuple[int, bytes]]:
    """(start, record) of the records that start from byte ``begin`` to before
    byte ``end`` of an open file; ``begin`` 0 is the start of a record. Empty
    ones are passed over."""
    width = len(separator)
    # the separator before the first record may begin before ``begin``, and where
    # one separator can overlap the next, so may the run of them that says which
    # of its bytes belong together: back to a byte that no separator has
    at = begin
    while at:
        back = max(at - _READ, 0)
        source.seek(back)
        rest = source.read(at - back).rstrip(separator)
        at = back + len(rest)
        if rest:
            break
    source.seek(at)
    held, offset = b"", at                  # held[0] is byte ``offset`` of the file
    start = 0 if begin == 0 else None       # of the record being read, once known
    scanned = 0
    while True:
        more = source.read(_READ) if offset + len(held) < size else b""
        held += more
        while True:
            cut = held.find(separator, scanned)
            if cut < 0:
                break
            if start is not None:
                if held[start - offset:cut].strip():
                    yield start, held[start - offset:cut]
            follows = offset + cut + width
            if follows >= end:
                return
            if start is not None or follows >= begin:
                start = follows
            scanned = cut + width
        if not more:
            if start is not None and held[start - offset:].strip():
                yield start, held[start - offset:]
            return
        keep = start - offset if start is not None else max(len(held) - width + 1, 0)
        scanned = max(len(held) - width + 1, scanned) - keep
        held, offset = held[keep:], offset + keep
        scanned = max(scanned, 0)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.separator = options["path"], options["separator"].encode()
        self.most = int(options.get("maxBytesPerTrigger", 0))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.sent: dict | None = None

    def _files(self) -> list[tuple[int, str, int]]:
        """(time in microseconds, path, bytes) of the landed files, in order."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns // 1000, f.path, f.size) for f in found
                      if f.type == pafs.FileType.File and f.base_name[:1] not in "._")

    def initialOffset(self) -> dict:
        return {"files": 0, "bytes": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        if not self.most:
            return {"files": len(files), "bytes": 0}
        now = dict(self.sent or self.initialOffset())
        room = self.most
        while room and now["files"] < len(files):
            step = min(room, files[now["files"]][2] - now["bytes"])
            room -= step
            now["bytes"] += step
            if now["bytes"] >= files[now["files"]][2]:
                now = {"files": now["files"] + 1, "bytes": 0}
        return now

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.sent = dict(end)
        files = self._files()
        out = []
        for number in range(start["files"], min(end["files"] + 1, len(files))):
            micros, path, size = files[number]
            begin = start["bytes"] if number == start["files"] else 0
            stop = end["bytes"] if number == end["files"] else size
            out += [Split(path, number, micros, a, min(a + self.split, stop))
                    for a in range(begin, stop, self.split)]
        return out

    def commit(self, end: dict) -> None:
        self.sent = dict(end)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        # a task's clock: file times are UTC
        ts = dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=partition.micros)
        rows: list[tuple[int, str]] = []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([(partition.number << FILE_BITS) + s for s, _ in rows], pa.int64()),
                 pa.array([ts] * n, pa.timestamp("us", tz="UTC")), pa.array([partition.path] * n, pa.string()),
                 pa.array([v for _, v in rows], pa.string())], names=["seq", "ts", "path", "value"])

        with fs.open_input_file(partition.path) as f:
            for s, raw in records(f, f.size(), partition.begin, partition.end, self.separator):
                rows.append((s, raw.decode("utf-8", "replace")))
                if len(rows) >= _ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class LandedRecords(DataSource):
    """``format("landed_records")`` with the options path, separator and, if
    wanted, maxBytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "landed_records"

    def schema(self) -> str:
        return "seq long, ts timestamp, path string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def record_stream(spark: SparkSession, path: str, separator: str, columns: list[str] | None = None,
                  max_bytes_per_trigger: int | None = None) -> DataFrame:
    """(seq, ts, value, *columns) of every record as it lands; ``columns`` are
    folder columns (``name=value``), as text."""
    # the readers run in Python processes that need not have this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LandedRecords)
    reader = (spark.readStream.format("landed_records").option("path", path)
              .option("separator", separator))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    folder = [F.regexp_extract("path", rf"/{c}=([^/]*)/", 1).alias(c) for c in columns or []]
    return reader.load().select("seq", "ts", "value", *folder)
