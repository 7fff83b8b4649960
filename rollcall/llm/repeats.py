"""Which hashes of a row also occur in another row, exactly, by one shuffle.

A function makes a key and an array of distinct 64-bit hashes of every row, in
the task that goes on with them, so one Python worker serves a task. A task
sorts what it holds: a hash that two of its keys have is settled there for
both, and only a mark of it goes on; a hash of one key goes on as (hash, key).
So a hash in a third of all rows is one entry per task, not one per row. The
part that owns a hash finds the rest. Parts are sized by the input, and a task
holds one part at a time.

The result has rows (key, hashes, n_found, n_low): some of the key's hashes
that occur under another key, how many, and how many of them are below 2^62;
a key can have many such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: entries (hash, key) a map task holds before it sends them
HELD = 1 << 18
LOW = np.uint64(1) << np.uint64(62)

_SCHEMA = "key long, hashes binary, n_found long, n_low long"


def _by_key(hashes: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed (key, hashes) rows from pairs."""
    if not len(hashes):
        return
    order = np.argsort(keys, kind="stable")
    hashes, keys = hashes[order], keys[order]
    cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    low = np.concatenate(([0], np.cumsum(hashes < LOW)))
    offsets = pa.py_buffer((cuts * 8).astype(np.int32).tobytes())
    data = pa.py_buffer(hashes.tobytes())
    n = len(cuts) - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[cuts[:-1]]), pa.Array.from_buffers(pa.binary(), n, [None, offsets, data]),
         pa.array(np.diff(cuts)), pa.array(low[cuts[1:]] - low[cuts[:-1]])],
        names=["key", "hashes", "n_found", "n_low"])


def repeated_hashes(rows: DataFrame, n_parts: int,
                    hashes_of: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]
                    ) -> DataFrame:
    """``hashes_of``: (key, distinct hashes) of every row of a batch."""

    def flush(hashes: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[tuple]:
        h, k = np.concatenate(hashes), np.concatenate(keys)
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
        h, k = h[new], k[new]                       # equal rows share a key
        first = np.concatenate(([True], h[1:] != h[:-1]))
        group = np.cumsum(first) - 1
        many = np.bincount(group)[group] > 1
        for b in _by_key(h[many], k[many]):
            # settled here: spread by key
            yield (pa.array(np.asarray(b.column(0)) % n_parts, pa.int64()), 0, b.column(0), b.column(1))
        ones, marks = ~many, many & first
        for kind, pick in ((1, ones), (2, marks)):
            hh, kk = h[pick], k[pick]
            part = (hh >> np.uint64(24)) % np.uint64(n_parts)
            order = np.argsort(part, kind="stable")
            hh, kk, part = hh[order], kk[order], part[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) \
                else np.zeros(1, np.int64)
            rows = [(int(part[a]), np.concatenate((hh[a:b], kk[a:b].view(np.uint64))).tobytes()
                     if kind == 1 else hh[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield (pa.array([r[0] for r in rows], pa.int64()), kind, None,
                   pa.array([r[1] for r in rows], pa.binary()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keys, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for part, kind, key, payload in flush(hashes, keys):
                n = len(part)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [part, pa.array([kind] * n, pa.int32()),
                         key if key is not None else pa.nulls(n, pa.int64()), payload],
                        names=["part", "kind", "key", "payload"])

        for b in batches:
            for key, h in hashes_of(b):
                if not len(h):
                    continue
                hashes.append(h)
                keys.append(np.full(len(h), key, np.int64))
                size += len(h)
                if size >= HELD:
                    yield from out()
                    hashes, keys, size = [], [], 0
        if size:
            yield from out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, marks = None, [], []

        def settle() -> Iterator[pa.RecordBatch]:
            if not pairs:
                return
            h = np.concatenate([p[:len(p) // 2] for p in pairs])
            k = np.concatenate([p[len(p) // 2:] for p in pairs]).view(np.int64)
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            start = np.flatnonzero(first)
            stop = np.append(start[1:], len(h)) - 1
            several = k[start] != k[stop]           # sorted: first and last key differ
            if marks:
                several |= np.isin(h[start], np.concatenate(marks))
            hit = np.repeat(several, stop - start + 1)
            hit &= np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))
            yield from _by_key(h[hit], k[hit])

        for b in batches:
            for part, kind, key, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                             b.column(2).to_pylist(), b.column(3)):
                vals = np.frombuffer(blob.as_buffer(), np.uint64)
                if kind == 0:
                    yield from _by_key(vals, np.full(len(vals), key, np.int64))
                    continue
                if part != now:
                    yield from settle()
                    now, pairs, marks = part, [], []
                (pairs if kind == 1 else marks).append(vals)
        yield from settle()

    sent = rows.mapInArrow(
        send, "part long, kind int, key long, payload binary")
    return (sent.repartition("part").sortWithinPartitions("part")
            .mapInArrow(match, _SCHEMA))
