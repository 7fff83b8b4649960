"""Token ids as flat files with 64-bit document offsets, memory-mapped.

Format of a part: ``<name>.bin`` holds the ids of its documents one after the
other, unsigned and little-endian, 16 bits wide when the vocabulary fits, else
32; ``<name>.idx`` holds, as signed 64-bit integers, the number of documents,
the id width in bytes, then for each document the place of its first id and
last the number of ids. ``<name>.doc`` holds the document ids as a Parquet
column, so any id type and null survive.

Parts are in ascending order of document id (nulls first) and so are the
documents in them: the texts are range-partitioned and sorted by Spark, and
each task encodes and appends document after document; it holds one batch.
The manifest, one row per part, is a Parquet table. Only files it names
count: a task that ran twice has written twice, under names of its own, and
Spark's commit of the manifest keeps one. The bases of the parts (documents
and ids before them) are prefix sums over the manifest.

Files are written and read through ``pyarrow.fs`` by the URI of the shared
folder; on a file system that is mounted they are read by memory map.

Null text has no ids but the end id. Repeated rows are repeated documents, in
any order among equals. An empty table has no parts and reads back empty.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches
from rollcall.llm.encode import encoder

#: documents read back into one batch hold about this many bytes of ids
READ_BYTES = 4 << 20


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return pafs.LocalFileSystem(), uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int | None = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text under ``path`` (a folder all
    executors share), with ``end_id`` after each document."""
    bounded_batches(docs.sparkSession)
    manifest_path = f"{path}/manifest"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, root = _file_system(path)
        enc = encoder(tokenizer_path)
        kind = np.dtype("<u2" if max(enc.vocabulary(), (end_id or 0) + 1) <= 1 << 16 else "<u4")
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        starts, ids, total = [0], [], 0
        out = doc = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(f"{root}/data", recursive=True)
                out = fs.open_output_stream(f"{root}/data/{name}.bin")
                doc = pq.ParquetWriter(f"{root}/data/{name}.doc", pa.schema([b.schema.field(0)]),
                                       filesystem=fs)
            for one in enc.ids(b.column(1)):
                flat = np.frombuffer(one + tail, "<u4")
                out.write(flat.astype(kind).tobytes())
                total += len(flat)
                starts.append(total)
            doc.write_batch(pa.RecordBatch.from_arrays([b.column(0)], names=[b.schema.names[0]]))
        if out is None:
            return
        out.close()
        doc.close()
        with fs.open_output_stream(f"{root}/data/{name}.idx") as f:
            f.write(np.array([len(starts) - 1, kind.itemsize, *starts], "<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([name]), pa.array([len(starts) - 1], pa.int64()),
             pa.array([total], pa.int64())], names=["part", "name", "n_docs", "n_ids"])

    (docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first())
     .sortWithinPartitions(F.col(id_col).asc_nulls_first())
     .mapInArrow(write, "part long, name string, n_docs long, n_ids long")
     .write.parquet(manifest_path))


def read_manifest(spark, path: str) -> DataFrame:
    """One row per part, with the documents and ids before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema("part long, name string, n_docs long, n_ids long").parquet(
        f"{path}/manifest")
    return rows.withColumns({
        "first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
        "first_id": F.coalesce(F.sum("n_ids").over(before), F.lit(0))})


class TokenPart:
    """One part, opened: ``ids(i)`` are document i's, without reading others."""

    def __init__(self, path: str, name: str):
        fs, root = _file_system(path)
        at = f"{root}/data/{name}"
        if isinstance(fs, pafs.LocalFileSystem):
            index = np.memmap(f"{at}.idx", "<i8", mode="r")
            self.flat = np.memmap(f"{at}.bin", f"<u{index[1]}", mode="r") if index[-1] else \
                np.zeros(0, f"<u{index[1]}")
        else:
            with fs.open_input_file(f"{at}.idx") as f:
                index = np.frombuffer(f.read(), "<i8")
            with fs.open_input_file(f"{at}.bin") as f:
                self.flat = np.frombuffer(f.read(), f"<u{index[1]}")
        self.starts = index[2:]
        with fs.open_input_file(f"{at}.doc") as f:
            self.docs = pq.read_table(io.BytesIO(f.read())).column(0).combine_chunks()

    def __len__(self) -> int:
        return len(self.starts) - 1

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i]:self.starts[i + 1]]


def read_token_files(spark, path: str, id_type: T.DataType | str = "long",
                     id_col: str = "doc_id") -> DataFrame:
    """Documents of the files at ``path``: id, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit)."""
    if isinstance(id_type, str):
        id_type = T.StructType.fromDDL(f"x {id_type}")["x"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = TokenPart(path, name)
                starts = np.asarray(part.starts)
                i = 0
                while i < len(part):
                    j = int(np.searchsorted(starts, starts[i] + READ_BYTES // 4, side="right")) - 1
                    j = min(max(j, i + 1), len(part))
                    yield pa.RecordBatch.from_arrays(
                        [part.docs.slice(i, j - i), pa.array(base + starts[i:j]),
                         pa.array(np.diff(starts[i:j + 1])),
                         pa.array([part.ids(k).astype("<u4").tobytes() for k in range(i, j)],
                                  pa.binary())],
                        names=[id_col, "start", "n_tokens", "ids"])
                    i = j

    manifest = read_manifest(spark, path).select("name", "first_id")
    return manifest.repartition(_parts(spark, path), "name").mapInArrow(read, schema)


def _parts(spark, path: str) -> int:
    """As many reading tasks as parts."""
    return max(1, spark.read.schema("part long").parquet(f"{path}/manifest").count())
