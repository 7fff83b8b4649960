"""Words of many texts at once, as numpy arrays over the Arrow buffer.

The operators that count or hash words share this kernel. A text column comes
as an Arrow string array; its bytes are looked at once, in slices of bounded
size, and no Python object is made per word. Words are maximal runs of bytes
that are not separators, so any UTF-8 text is cut only at ASCII bytes.

Hashes are 64 bits wide and do not depend on where a word stands, on the
slice, or on the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: white space of the contracts: space and the bytes 9 to 13
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20

#: bytes of text handled at once (about 60 bytes of arrays per byte of text)
SLICE_BYTES = 1 << 19
#: words longer than this are hashed one by one
_LONG_WORD = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants, the same everywhere."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mix(x) | np.uint64(1)


_BYTE = constants(256, 11)
_PLACE = constants(_LONG_WORD, 23)


def string_slices(texts: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES
                  ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows, at most
    ``slice_bytes`` at a time, but one whole row at least. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(off, off[row] + slice_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, raw[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


class Words:
    """Words of one slice: byte ranges ``start``/``end`` and the ``row`` each
    word stands in, in text order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False,
                 separators: np.ndarray = SPACE):
        self.data = _FOLD[data] if fold else data
        self.offsets = offsets
        self.rows = len(offsets) - 1
        n = len(data)
        inside = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)   # a text's first byte: no word runs over it
        edge[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def per_row(self, row: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
        row = self.row if row is None else row
        return np.bincount(row, weights=weights, minlength=self.rows)[:self.rows].astype(np.int64)

    def first(self) -> np.ndarray:
        """Index of each row's first word, and the total at the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1), side="left")

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        gap = np.diff(np.append(self.start, len(self.data)))
        lead = int(self.start[0])
        place = np.arange(lead, len(self.data)) - np.repeat(self.start, gap)
        vals = _BYTE[self.data[lead:]] * _PLACE[place & (_LONG_WORD - 1)]
        vals[~self.inside[lead:]] = 0   # separators between two words
        out = np.add.reduceat(vals, self.start - lead)
        out = mix(out + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(length > _LONG_WORD):
            import hashlib
            word = self.data[self.start[i]:self.end[i]].tobytes()
            out[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64)[0]
        return out

    def ngrams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words of a row."""
        if len(hashes) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:len(hashes) - k + 1] == self.row[k - 1:])
        c = constants(k, 37)
        total = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            total += hashes[at + j] * c[j]
        return at, mix(total)


def code_points(data: np.ndarray) -> np.ndarray:
    """1 where a UTF-8 character begins."""
    return (data & 0xC0) != 0x80
