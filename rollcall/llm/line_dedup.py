"""Line dedup with two Bloom filters.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends
and with A-Z in lower case. Keys of at least ``min_chars`` code points that
stand in at least ``min_docs`` documents are repeated lines.

1. Every task builds both filters over its own lines, block by block: a "seen once" and a
   "seen twice" filter (keys of two of its documents). No line and no hash is
   shuffled, only the parts of these filters that have bits (two bytes a bit, or
   the bitmap where that is shorter). Merged part by part, a bit is seen twice if it
   is so in one of them or seen once in two of them.
2. The twice filter, at most ``max_filter_bits`` bits whatever the input, is
   broadcast. Lines it rules out are certainly unique and never shuffle.
   Suspected keys are counted exactly over all documents (128-bit digest,
   map-side combine). Past the bound the filter lets more unique keys through
   to that count; the result stays the same.
3. The digests of the repeated keys are counted. Up to ``BROADCAST_BYTES`` of
   them are broadcast, and every document is finished where it is read. Beyond
   that, only documents without a suspected line are; the others are joined
   with the repeated keys they hold (found by a join on the digest).

``keep_first=False`` drops all lines of a repeated key, ``True`` keeps the
first one (smallest document id, first place in it).

Null text is one empty line; an empty key (under ``min_chars``) is never
repeated. A line repeated within one document counts once. Every row counts as
a document, so repeated rows do too. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, fresh, row_key, schema_with, written

WHITE = b" \t\n\x0b\x0c\r"
#: the twice filter in bits: 8 for each line, between the two bounds
MIN_FILTER_BITS = 1 << 18
MAX_FILTER_BITS = 1 << 28
#: hash entries a map task holds before it sends them
HELD = 1 << 20
PART_BITS = 1 << 16
#: digests of repeated keys that are broadcast, at most (16 bytes each)
BROADCAST_BYTES = 4 << 20


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """(lines, keys) of a text; null is one empty line."""
    lines = (text or "").encode("utf-8").split(b"\n")
    return lines, [line.strip(WHITE).lower() for line in lines]   # bytes.lower: A-Z only


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8")) >= min_chars


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bit places of each hash, both within the hash's part."""
    part_bits = min(PART_BITS, bits)
    base = (hashes >> np.uint64(40)) % np.uint64(bits // part_bits) * np.uint64(part_bits)
    return [base + (hashes & np.uint64(part_bits - 1)),
            base + ((hashes >> np.uint64(20)) & np.uint64(part_bits - 1))]


def _parts(slots: np.ndarray, size: int) -> dict[int, bytes]:
    """Sorted bit places as parts of ``size`` bits: two bytes a place, or the
    bitmap where that is no longer."""
    part = (slots // np.uint64(size)).astype(np.int64)
    place = (slots % np.uint64(size)).astype(np.uint16)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else [0]
    out = {}
    for a, b in zip(cuts, cuts[1:]):
        held = place[a:b]
        if len(held) >= size // 16:
            bitmap = np.zeros(size, bool)
            bitmap[held] = True
            held = np.packbits(bitmap)
        out[int(part[a])] = held.tobytes()
    return out


def _places(part: bytes, size: int) -> np.ndarray:
    """The bit places of one of ``_parts``."""
    if len(part) == size // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8)))
    return np.frombuffer(part, np.uint16).astype(np.int64)


def twice_filter(docs: DataFrame, text_col: str, min_chars: int, bits: int) -> np.ndarray:
    """The seen-twice filter over the line keys of all documents, as bytes
    packed eight bits each (``bits`` is a power of two)."""
    size = min(PART_BITS, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for b in batches:
            for text in b.column(0):
                keys = set(line_keys(text.as_py())[1])
                held += [_hash(k) for k in keys if _long_enough(k, min_chars)]
                if len(held) >= HELD:
                    yield filters(held)
                    held = []
        if held:
            yield filters(held)

    def filters(held: list[int]) -> pa.RecordBatch:
        """The parts of both filters over these lines that have bits."""
        vals, n = np.unique(np.array(held, dtype=np.uint64), return_counts=True)
        once, twice = (_parts(np.unique(np.concatenate(_slots(v, bits))), size)
                       for v in (vals, vals[n > 1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(once), pa.int32()), pa.array(list(once.values()), pa.binary()),
             pa.array([twice.get(p, b"") for p in once], pa.binary())], names=["part", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def bitmap() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())],
                names=["part", "bits"])

        for b in batches:
            for part, o, t in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    if now is not None:
                        yield bitmap()
                    now, once, twice = part, np.zeros(size, bool), np.zeros(size, bool)
                o = _places(o, size)
                twice[o[once[o]]] = True        # in both once filters
                twice[_places(t, size)] = True
                once[o] = True
        if now is not None:
            yield bitmap()

    sent = docs.select(text_col).mapInArrow(send, "part int, once binary, twice binary")
    parts = (sent.repartition("part").sortWithinPartitions("part")
             .mapInArrow(merge, "part int, bits binary"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():      # bits / 8 bytes in all
        out[row["part"] * size // 8:(row["part"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _suspected(keys: list[bytes], packed: np.ndarray, min_chars: int) -> set[bytes]:
    """The distinct keys that the twice filter does not rule out."""
    distinct = [k for k in set(keys) if _long_enough(k, min_chars)]
    if not distinct:
        return set()
    h = np.array([_hash(k) for k in distinct], dtype=np.uint64)
    hit = np.ones(len(h), dtype=bool)
    for s in _slots(h, len(packed) * 8):
        hit &= ((packed[(s >> np.uint64(3)).astype(np.int64)]
                 >> (np.uint64(7) - (s & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
    return {k for k, x in zip(distinct, hit) if x}


def filter_bits(docs: DataFrame, text_col: str, max_filter_bits: int) -> int:
    """Eight bits per line, as a power of two between the bounds."""
    lines = docs.agg(F.sum(F.coalesce(F.length(text_col) - F.length(F.replace(
        F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(1)))).first()[0] or 0
    bits = MIN_FILTER_BITS
    while bits < 8 * lines and bits < max_filter_bits:
        bits *= 2
    return bits


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                min_chars: int = 1, min_docs: int = 2, keep_first: bool = False,
                max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``docs`` with the kept lines of each text, joined by newline, in
    ``text_col``, and ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()),
              T.StructField("n_dropped", T.LongType())]
    schema = schema_with(docs, *fields)
    order = [f.name for f in schema.fields[:-3]]
    docs = docs.select(*order, text_col)
    key = fresh(docs, "_key")
    packed = spark.sparkContext.broadcast(
        twice_filter(docs, text_col, min_chars, filter_bits(docs, text_col, max_filter_bits)))

    # suspected keys of each document, counted exactly
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = packed.value
        for b in batches:
            keys, digests = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = _suspected(line_keys(text.as_py())[1], bits, min_chars)
                keys += [k] * len(found)
                digests += [_digest(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(digests, pa.binary())],
                names=["_key", "_digest"])

    keyed = docs.select(row_key(id_col, text_col).alias(key), *docs.columns)
    by_doc = keyed.select(key, text_col).mapInArrow(pairs, "_key long, _digest binary")
    repeated = written(by_doc.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
                       .where(F.col("_n") >= min_docs).select("_digest"), "line-dedup-repeated")
    if keep_first:
        named = keyed.select(key, id_col, text_col).mapInArrow(
            _with_id(pairs), T.StructType([T.StructField("_key", T.LongType()),
                                           T.StructField("_digest", T.BinaryType()),
                                           T.StructField("_id", docs.schema[id_col].dataType)]))
        repeated = written(named.join(repeated, "_digest", "left_semi").groupBy("_digest")
                           .agg(F.min(F.struct("_id", "_key")).alias("_f"))
                           .select("_digest", F.col("_f._key").alias("_first")), "line-dedup-firsts")
    else:
        repeated = repeated.withColumn("_first", F.lit(None).cast("long"))

    def finished(b: pa.RecordBatch, texts: pa.Array, drops: list[dict | None]) -> pa.RecordBatch:
        """Output rows: per text the digests to drop, with True where the first
        line of that key stays."""
        out, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts, drops):
            text = text.as_py()
            lines, keys = line_keys(text)
            n_lines.append(len(lines))
            if not drop:
                out.append(text)
                n_dropped.append(0)
                continue
            kept = []
            for line, k in zip(lines, keys):
                d = _digest(k)
                if drop.get(d, True):
                    kept.append(line)
                    if d in drop:
                        drop[d] = False
            out.append(b"\n".join(kept).decode("utf-8"))
            n_dropped.append(len(lines) - len(kept))
        return pa.RecordBatch.from_arrays(
            b.columns[:len(order)] + [pa.array(out, pa.string()), pa.array(n_lines, pa.int64()),
                                      pa.array(n_dropped, pa.int64())],
            names=order + [f.name for f in fields])

    columns = docs.columns
    if repeated.count() * 16 <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast(
            {bytes(r["_digest"]): r["_first"] for r in repeated.collect()})

        def finish_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, firsts = packed.value, held.value
            for b in batches:
                texts, drops = b.column(len(order) + 1), []
                for k, text in zip(b.column(0).to_pylist(), texts):
                    found = [_digest(x) for x in _suspected(line_keys(text.as_py())[1], bits, min_chars)]
                    drops.append({d: firsts[d] == k for d in found if d in firsts})
                yield finished(pa.RecordBatch.from_arrays(b.columns[1:], names=columns),
                               texts, drops)

        return keyed.mapInArrow(finish_here, schema)

    hits = by_doc.join(repeated, "_digest")
    entry = F.struct("_digest", F.col("_key").eqNullSafe(F.col("_first")).alias("_keep"))
    decisions = written(hits.groupBy("_key").agg(F.collect_set(entry).alias("_hits")),
                        "line-dedup-decisions")

    def suspect_rows(b: pa.RecordBatch, column: int) -> np.ndarray:
        bits = packed.value
        return np.array([bool(_suspected(line_keys(t.as_py())[1], bits, min_chars))
                         for t in b.column(column)], dtype=bool)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(suspect_rows(b, b.num_columns - 1)))

    def clean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~suspect_rows(b, len(order))))
            lines = [(t.as_py() or "").count("\n") + 1 for t in b.column(len(order))]
            yield pa.RecordBatch.from_arrays(
                b.columns + [pa.array(lines, pa.int64()), pa.array([0] * len(lines), pa.int64())],
                names=order + [f.name for f in fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(len(order) + 1).to_pylist()
            yield finished(b, b.column(len(order)),
                           [{h["_digest"]: h["_keep"] for h in x} if x else None for x in hits])

    hits_name = fresh(docs, "_hits")
    dirty = (keyed.mapInArrow(suspects, keyed.schema)
             .join(decisions.withColumnsRenamed({"_key": key, "_hits": hits_name}), key, "left")
             .drop(key))
    return docs.mapInArrow(clean_rows, schema).unionByName(dirty.mapInArrow(finish, schema))


def _with_id(pairs):
    """``pairs`` over (key, id, text) rows, carrying the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for out in pairs(iter([pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2)], names=["_key", "_text"])])):
                keys = out.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array([ids[k] for k in keys], b.schema.field(1).type)],
                    names=["_key", "_digest", "_id"])
    return run
