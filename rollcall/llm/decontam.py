"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised byte by byte: A-Z become a-z, every other ASCII byte that
is no digit or small letter becomes a space; bytes of non-ASCII characters stay.
Words are what stands between the spaces. The patterns are the windows of
``window`` consecutive words of every benchmark item (an item of fewer words is
one window), and one automaton holds all of them, so each text is scanned once
whatever the number of items. Normalisation keeps every byte's place, so a hit
maps back to the original text directly.

The distinct patterns, each with the items that have it, are a Spark job over the
benchmark; measured, they are written to the shared folder in blocks of about
``block_bytes``. The driver holds the blocks' paths, nothing is broadcast. A worker
opens a block and builds its automaton where it scans, one at a time; usually
there is one block, which the worker keeps. A larger benchmark is scanned block
after block, a group of texts at a time, with the same result.

Null and empty texts have no words and are not contaminated. Null, empty or
wordless items have no window. Items with equal text are all named. An item
whose id is null counts for hits but has no name. Repeated rows are judged each, an
empty table gives an empty table, other columns pass through (one named as a
result gives way to it).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, fresh, schema_with, shared_files, written
from rollcall.llm.words import code_points
from rollcall.session import child_names, scratch_path

WINDOW = 13
#: a text is contaminated when hit words * 20 reach its words
SHARE = 20
BLOCK_BYTES = 32 << 20
#: bytes of texts scanned together where there are several blocks
GROUP_BYTES = 32 << 20

_NORM = bytes(
    c + 0x20 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80
    else 0x20 for c in range(256))


def norm_words(text: str | None) -> tuple[bytes, list[bytes]]:
    norm = (text or "").encode("utf-8").translate(_NORM)
    return norm, norm.split()


def windows(text: str | None, window: int) -> set[bytes]:
    words = norm_words(text)[1]
    if not words:
        return set()
    last = max(1, len(words) - window + 1)
    return {b" ".join(words[i:i + window]) for i in range(last)}


#: the automaton this worker built last, by its block
_BUILT: dict[str, object] = {}


def _automaton(block: str):
    if block not in _BUILT:
        _BUILT.clear()
        fs, root = shared_files(block)
        a = ahocorasick.Automaton()
        for f in sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".parquet")):
            for batch in pq.ParquetFile(fs.open_input_file(f)).iter_batches(1 << 14):
                for pattern, items in zip(batch.column("pattern").to_pylist(), batch.column("items").to_pylist()):
                    p = " " + pattern.decode("latin-1") + " "
                    a.add_word(p, (len(p), tuple(items)))
        a.make_automaton()
        _BUILT[block] = a
    return _BUILT[block]


def scan(blocks: list[str], texts: list[str]) -> list[list[tuple[int, int, tuple]]]:
    """Per text (words joined by single spaces, a space at both ends) the
    matches (first byte of the first word, one past the last, items)."""
    found: list[list] = [[] for _ in texts]
    for block in blocks:
        a = _automaton(block)
        for hits, text in zip(found, texts):
            for end, (length, items) in a.iter(text):
                hits.append((end - length + 2, end, items))
    return found


def patterns(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, items) of the distinct windows; items sorted as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                found = sorted(windows(b.column(1)[row].as_py(), window))
                for k in range(0, len(found), 1 << 14):
                    some = found[k:k + (1 << 14)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.binary()), pa.array([b.column(0)[row].as_py()] * len(some), pa.string())],
                        names=["pattern", "item"])

    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col))
    return (rows.mapInArrow(run, "pattern binary, item string")
            .groupBy("pattern").agg(F.array_sort(F.collect_set("item")).alias("items")))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """The folders of the written blocks."""
    spark = benchmark.sparkSession
    table = written(patterns(benchmark, item_col, text_col, window), "decontam-patterns")
    total = table.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    path = scratch_path(spark, "decontam-blocks")
    (table.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(n)).cast("int"))
     .repartition(n, "block").write.partitionBy("block").parquet(path))
    return [f"{path}/{name}" for name in child_names(spark, path) if name.startswith("block=")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *,
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  share: int = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside an occurrence of a
    window), ``items`` (names of the items with one, sorted as strings),
    ``spans`` (merged code point ranges of the hits in the original text) and
    ``contaminated`` (n_hit > 0 and share * n_hit >= n_words)."""
    bounded_batches(docs.sparkSession)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
              T.StructField("items", T.ArrayType(T.StringType())),
              T.StructField("spans", T.ArrayType(span)),
              T.StructField("contaminated", T.BooleanType())]
    schema = schema_with(docs, *fields)
    order = [f.name for f in schema.fields[:-len(fields)]]
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if len(blocks) == 1 else _groups(batches):
            normed = [norm_words(t.as_py()) for t in b.column(b.num_columns - 1)]
            joined = [(b" " + b" ".join(w) + b" ").decode("latin-1") for _, w in normed]
            n_hit, items, spans = [], [], []
            for (norm, words), text, hits in zip(normed, joined, scan(blocks, joined)):
                if not hits:
                    n_hit.append(0), items.append([]), spans.append([])
                    continue
                covered = _covered(words, hits)
                n_hit.append(int(covered.sum()))
                items.append(sorted({i for _, _, named in hits for i in named}))
                spans.append(_original(norm, words, covered))
            n_words = np.array([len(w) for _, w in normed], dtype=np.int64)
            hit = np.array(n_hit, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                b.columns[:len(order)]
                + [pa.array(n_words), pa.array(hit), pa.array(items, pa.list_(pa.string())),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                   pa.array((hit > 0) & (share * hit >= n_words))],
                names=order + [f.name for f in fields])

    return docs.select(*order, F.col(text_col).alias(fresh(docs, "_text"))).mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about GROUP_BYTES: each block is opened once for each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= GROUP_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _covered(words: list[bytes], hits: list[tuple]) -> np.ndarray:
    """Which words lie inside a match."""
    at = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])   # places in the joined text
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    first = np.searchsorted(at, [h[0] for h in hits])
    last = np.searchsorted(at, [h[1] for h in hits])
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    return np.cumsum(edges[:-1]) > 0


def _original(norm: bytes, words: list[bytes], covered: np.ndarray) -> list[dict]:
    """Runs of covered words as code point ranges of the original text."""
    raw = np.frombuffer(norm, dtype=np.uint8)
    inside = raw != 0x20
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    end = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    point = np.concatenate(([0], np.cumsum(code_points(raw), dtype=np.int64)))
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return [{"start": int(point[start[i]]), "end": int(point[end[j - 1]])}
            for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
