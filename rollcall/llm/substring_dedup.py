"""Substring dedup by content-defined chunking.

Words are runs without white space, A-Z in lower case, so spacing and case do
not matter. A gear hash rolls over the words (each step shifts the state by one
bit and adds the hash of the next word); where two bits of it, which depend on
the last four words alone, are zero, a chunk ends. Where chunks end depends on
the words near by only, so an insertion moves no later boundary. A stretch of
``MAX_CHUNK`` words without an end is cut there (texts that repeat one word).

1. The unit that is compared is a run of whole chunks of at least ``run_words``
   words, one from every chunk start, by digest. One shuffle of 16 bytes a run
   finds the runs that another document has too (``repeats``).
2. Documents with such a run are read again. Every window of ``min_words``
   words that can be repeated there is digested (128 bits): each that starts in
   a chunk whose run is repeated, or near by, unless a run inside it is not.
3. Windows are counted exactly over documents. They travel in stretches: windows
   that follow each other and have the same least hash of ``GRAM`` words inside.
   That hash depends on a window's words alone and says which part counts it. Of
   the windows a task holds, equal stretches are sent once, with a small row for
   each place they stand at, so a passage in very many documents is few digests
   in its part. The owner
   of a window in two documents or more is the least id that has it. A passage
   is a stretch of overlapping windows with one owner: it ends where the next
   repeated window has another, or only touches it.

Each result row is one passage: the document, its code point range there, its
words, the owner (``first_id``), and whether this document is the owner
(``keep``). So a repeated window lies in passages to keep in its owner alone.
Passages of different owners can overlap; ``drop_start`` and ``drop_end`` are the
part of a passage not to keep that no passage to keep reaches into (null where
there is none): dropping these ranges leaves every repeated window whole in its
owner. A document without a repeated passage has no row. A passage that repeats
only within one document is not reported. Null and empty texts have no words. Rows equal in id and text count as one document. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, row_key, written
from rollcall.llm.repeats import repeated_hashes
from rollcall.llm.words import Words, code_points, constants, mix, string_slices

MIN_WORDS = 50
RUN_WORDS = 20
MAX_CHUNK = 32
PART_BYTES = 16 << 20
GRAM = 12
#: windows in a stretch at most, and windows a task holds before it sends them
MAX_STRETCH = 1 << 12
HELD = 1 << 18


class Chunks:
    """Chunk ends and run digests of one slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, run_words: int = RUN_WORDS):
        self.words = w = Words(data, offsets, fold=True)
        self.hash = w.hashes()
        n = len(w)
        gear = np.zeros(n, dtype=np.uint64)
        for j in range(min(4, n)):
            same = w.row[j:] == w.row[:n - j]
            gear[j:] += np.where(same, self.hash[:n - j] << np.uint64(j), np.uint64(0))
        ends = (gear >> np.uint64(2)) & np.uint64(3) == 0
        first = w.first()
        bound = np.concatenate((np.flatnonzero(ends) + 1, first))   # chunks start here
        bound = np.unique(bound[bound <= n])
        self.natural = bound
        gaps = np.flatnonzero(np.diff(bound) > MAX_CHUNK)
        if len(gaps):
            extra = [np.arange(bound[g] + MAX_CHUNK, bound[g + 1], MAX_CHUNK) for g in gaps]
            bound = np.unique(np.concatenate([bound, *extra]))
        self.bound = bound
        self.first = first
        # a run: from a chunk start to the first chunk end run_words on
        start = bound[bound < n]
        stop_at = np.searchsorted(bound, start + run_words)
        ok = stop_at < len(bound)
        start, stop = start[ok], bound[stop_at[ok]]
        last_row = first[w.row[start] + 1] if len(start) else start
        ok = stop <= last_row
        self.start, self.stop = start[ok], stop[ok]
        a, = self.digests(self.start, self.stop, seeds=(71,))
        self.run = mix(a + (self.stop - self.start).astype(np.uint64))

    def digests(self, start: np.ndarray, stop: np.ndarray, seeds=(71, 73)) -> list[np.ndarray]:
        """A polynomial hash of the words start..stop-1 per seed."""
        n = len(self.hash)
        out = []
        for seed in seeds:
            r = int(constants(1, seed)[0])
            power = np.multiply.accumulate(np.concatenate(
                ([np.uint64(1)], np.full(n, r, dtype=np.uint64))))
            back = np.multiply.accumulate(np.concatenate(
                ([np.uint64(1)], np.full(n, pow(r, -1, 1 << 64), dtype=np.uint64))))
            total = np.concatenate(([np.uint64(0)], np.cumsum(self.hash * power[:n])))
            out.append(mix((total[stop] - total[start]) * back[start]))
        return out

    def least_grams(self, at: np.ndarray, size: int) -> np.ndarray:
        """The least hash of ``GRAM`` words in the windows of ``size`` words from ``at``."""
        gram = min(GRAM, size)
        start = np.arange(len(self.hash) - gram + 1)
        least, = self.digests(start, start + gram, seeds=(79,))
        have, want = 1, size - gram + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        return least[at]

    def runs_of_rows(self) -> list[np.ndarray]:
        """The distinct run digests of every row."""
        row = self.words.row[self.start] if len(self.start) else np.zeros(0, np.int64)
        cut = np.searchsorted(row, np.arange(self.words.rows + 1))
        return [np.unique(self.run[a:b]) for a, b in zip(cut, cut[1:])]

    def window_starts(self, row: int, repeated: np.ndarray, size: int) -> np.ndarray:
        """First words of the windows to digest, around runs in ``repeated``."""
        lo, hi = int(self.first[row]), int(self.first[row + 1])
        at = slice(*np.searchsorted(self.start, (lo, hi)))
        start, stop = self.start[at], self.stop[at]
        hit = np.isin(self.run[at], repeated)
        if not hit.any() or hi - lo < size:
            return np.zeros(0, np.int64)
        # A chunk end four words or more into a passage is one in all its
        # copies, and so are the run from there and the cuts of long chunks.
        # So a passage begins less than four words before the end that precedes
        # its first run, and a window starts in or just after a chunk of a run.
        bound = self.natural
        begin = bound[np.maximum(np.searchsorted(bound, start[hit]) - 1, 0)] - 3
        after = np.searchsorted(bound, start[hit], side="right")
        end = bound[np.minimum(after, len(bound) - 1)] + 2
        cover = np.zeros(hi - size - lo + 2, dtype=np.int64)
        np.add.at(cover, np.clip(begin - lo, 0, len(cover) - 1), 1)
        np.add.at(cover, np.clip(end - lo, 0, len(cover) - 1), -1)
        out = lo + np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        # a repeated window has no run inside that is not repeated (a run that
        # the text's end cut is not one in a copy that goes on)
        own = np.isin(start, bound) & (stop < hi)
        missed = np.concatenate(([0], np.cumsum(~hit[own])))
        a = np.searchsorted(start[own], out + 4)
        b = np.searchsorted(stop[own], out + size, side="right")
        return out[missed[np.maximum(a, b)] == missed[a]]


def stretch_cuts(at: np.ndarray, rows: np.ndarray, least: np.ndarray, longest: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``longest`` windows of one row that follow each other
    with the same ``least``."""
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(rows) != 0) | (least[1:] != least[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        for i in range(a, b, longest):
            yield i, min(i + longest, b)


def _steps(start: np.ndarray, end: np.ndarray) -> bytes:
    """How far ``start`` and ``end`` move from each window to the next, a byte
    each if that is enough."""
    steps = np.concatenate((np.diff(start), np.diff(end)))
    return steps.astype(np.uint8 if not len(steps) or steps.max() < 256 else np.int32).tobytes()


def _sums(steps: bytes, n: int, i: int, j: int) -> tuple[int, int]:
    """How far the start moved up to window i and the end up to window j of n."""
    if n == 1:
        return 0, 0
    both = np.frombuffer(steps, np.uint8 if len(steps) == 2 * (n - 1) else np.int32)
    return int(both[:i].sum()), int(both[n - 1:n - 1 + j].sum())


def _id_order(x) -> tuple:
    """Ids in Spark's order, null last: ``min`` takes it only if there is no other."""
    return x is None, x != x, x


def _record_batch(rows: list[tuple], schema: T.StructType, id_fields, id_arrow: pa.DataType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(),
             T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(values, id_arrow if f.name in id_fields else kinds[f.dataType])
         for f, values in zip(schema.fields, zip(*rows))], names=schema.names)


def owned_windows(stretches: list[tuple]) -> dict[tuple, list[tuple]]:
    """From all stretches of a part (reference, key, least id, whether several
    keys have it, digests): by reference, the windows that several keys have, as
    (first, last, owner) of windows that follow each other with one owner."""
    if not stretches:
        return {}
    refs, keys, ids, several, bodies = zip(*stretches)
    order = sorted(range(len(ids)), key=lambda i: _id_order(ids[i]))
    rank, names = np.zeros(len(ids), np.int64), []
    for i in order:
        if not names or names[-1] != ids[i]:
            names.append(ids[i])
        rank[i] = len(names) - 1
    digests = np.frombuffer(b"".join(bodies), np.uint64).reshape(-1, 2)
    size = np.array([len(b) // 16 for b in bodies])
    first = np.concatenate(([0], np.cumsum(size)))
    stretch = np.repeat(np.arange(len(bodies)), size)
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    d, s = digests[order], stretch[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1)))
    at = np.flatnonzero(new)
    key = np.array(keys, np.int64)[s]
    many = np.logical_or.reduceat(np.array(several, bool)[s], at)
    many |= np.minimum.reduceat(key, at) != np.maximum.reduceat(key, at)
    least = np.where(many, np.minimum.reduceat(rank[s], at), -1)
    owner = np.empty(len(d), np.int64)
    owner[order] = least[np.cumsum(new) - 1]
    cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])))
    begin = np.flatnonzero(cut)
    stop = np.append(begin[1:], len(owner)) - 1
    out: dict[tuple, list[tuple]] = {}
    for i, j in zip(begin.tolist(), stop.tolist()):
        if owner[i] >= 0:
            k = stretch[i]
            out.setdefault(refs[k], []).append((i - int(first[k]), j - int(first[k]), names[owner[i]]))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                      min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per repeated passage of a document: id, ``start``, ``end`` (code
    points, end exclusive), ``n_words``, ``first_id``, ``keep``."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    keyed = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"),
                        F.col(text_col).alias("_text"))

    def runs(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        keys = b.column(0).to_pylist()
        for row, data, offsets in string_slices(b.column(1)):
            found = Chunks(data, offsets, run_words).runs_of_rows()
            yield from zip(keys[row:row + len(found)], found)

    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    found = repeated_hashes(keyed.select("_key", "_text"), max(64, total // PART_BYTES), runs)
    suspects = written(found.groupBy(F.col("key").alias("_key"))
                       .agg(F.collect_list("hashes").alias("_hits")), "substring-suspects")

    # kind 0: the digests of a stretch and who has it; kind 1: a place it stands at
    sent = T.StructType(
        [T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType()),
         T.StructField("sender", T.LongType()), T.StructField("number", T.LongType()),
         T.StructField("key", T.LongType()), T.StructField("id", id_type),
         T.StructField("several", T.BooleanType()), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("word", "start", "end")]
        + [T.StructField("payload", T.BinaryType())])
    n_parts = max(64, total // PART_BYTES)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held = TaskContext.get().partitionId() << 32, 0
        stretches: dict[bytes, list] = {}      # digests: number, part, key, id, several
        places: list[tuple] = []

        def flush(id_arrow: pa.DataType) -> pa.RecordBatch:
            rows = places + [(part, 0, sender, number, key, own, several, len(body) // 16, 0, 0, 0, body)
                             for body, (number, part, key, own, several) in stretches.items()]
            return _record_batch(rows, sent, ("id",), id_arrow)

        for b in batches:
            hits = [np.concatenate([np.frombuffer(x, np.uint64) for x in h])
                    for h in b.column(3).to_pylist()]
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for row, data, offsets in string_slices(b.column(2)):
                c = Chunks(data, offsets, run_words)
                starts = [c.window_starts(r, hits[row + r], min_words) for r in range(c.words.rows)]
                at = np.concatenate(starts).astype(np.int64)
                if not len(at):
                    continue
                rows = np.repeat(np.arange(c.words.rows), [len(s) for s in starts])
                digests = np.stack(c.digests(at, at + min_words), axis=1)
                least = c.least_grams(at, min_words)
                point = np.concatenate(([0], np.cumsum(code_points(data), dtype=np.int64)))
                base = point[offsets[rows]]
                start = point[c.words.start[at]] - base
                end = point[c.words.end[at + min_words - 1]] - base
                word = at - c.first[rows]
                for i, j in stretch_cuts(at, rows, least, MAX_STRETCH):
                    body = digests[i:j].tobytes()
                    key, own = keys[row + rows[i]], ids[row + rows[i]]
                    part = int(least[i] % np.uint64(n_parts))
                    known = stretches.setdefault(body, [len(stretches), part, key, own, False])
                    if known[2] != key:
                        known[3:] = [min(known[3], own, key=_id_order), True]
                    places.append((part, 1, sender, known[0], key, own, None, j - i, int(word[i]),
                                   int(start[i]), int(end[i]), _steps(start[i:j], end[i:j])))
                held += len(at)
                if held >= HELD:
                    yield flush(b.column(1).type)
                    stretches, places, held, sender = {}, [], 0, sender + 1
        if places:
            yield flush(b.column(1).type)

    shared = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_id", id_type)]
                          + [T.StructField(c, T.LongType()) for c in ("_word", "_last", "_start", "_end")]
                          + [T.StructField("_first", id_type)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stretches, owned = None, [], None
        for b in batches:
            rows = []
            for part, kind, sender, number, key, own, several, n, word, start, end, payload in zip(
                    *(c.to_pylist() for c in b.columns)):
                if part != now:
                    now, stretches, owned = part, [], None
                if kind == 0:
                    stretches.append(((sender, number), key, own, several, payload))
                    continue
                if owned is None:           # sorted: all stretches of the part came before
                    owned, stretches = owned_windows(stretches), []
                for i, j, owner in owned.get((sender, number), ()):
                    to_start, to_end = _sums(payload, n, i, j)
                    rows.append((key, own, word + i, word + j, start + to_start, end + to_end, owner))
            if rows:
                yield _record_batch(rows, shared, ("_id", "_first"), b.schema.field(5).type)

    placed = (keyed.join(suspects, "_key").mapInArrow(windows, sent)
              .repartition("part").sortWithinPartitions("part", "kind").mapInArrow(settle, shared))
    hit = (written(placed, "substring-shared").groupBy("_key")
           .agg(F.min("_id").alias("_id"),
                F.array_sort(F.collect_set(F.struct("_word", "_last", "_start", "_end", "_first"))).alias("_w")))

    out = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()), T.StructField("n_words", T.LongType()),
                        T.StructField("first_id", id_type), T.StructField("keep", T.BooleanType()),
                        T.StructField("drop_start", T.LongType()), T.StructField("drop_end", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (own, held) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                stretches = owned_stretches(
                    [(w["_word"], w["_last"], w["_start"], w["_end"], w["_first"]) for w in held], own, min_words)
                rows += [(i, *r) for r in stretches]
            at, start, end, n_words, first, keep, cut, cut_end = zip(*rows) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                 pa.array(n_words, pa.int64()), pa.array(first, b.schema.field(0).type),
                 pa.array(keep, pa.bool_()), pa.array(cut, pa.int64()), pa.array(cut_end, pa.int64())],
                names=out.names)

    return hit.select("_id", "_w").mapInArrow(merge, out)


def owned_stretches(windows: list[tuple], own, size: int) -> list[tuple]:
    """(start, end, words, owner, keep, drop start, drop end) of the passages of
    one document, from its repeated windows (first words of the first and the
    last of some that follow each other, start, end, owner) in order."""
    runs: list[list] = []
    for word, last, start, end, owner in windows:
        if runs and runs[-1][4] == owner and word < runs[-1][3]:
            runs[-1][1], runs[-1][3] = max(runs[-1][1], end), max(runs[-1][3], last + size)
        else:
            runs.append([start, end, word, last + size, owner])
    out: list[list] = []
    kept_to = 0
    for start, end, word, stop, owner in runs:
        keep = owner == own
        out.append([start, end, stop - word, owner, keep, None if keep else max(start, kept_to), None])
        kept_to = max(kept_to, end) if keep else kept_to
    kept_from = None
    for r in reversed(out):
        if r[4]:
            kept_from = r[0]
            continue
        r[6] = r[1] if kept_from is None else min(r[1], kept_from)
        if r[6] <= r[5]:
            r[5] = r[6] = None
    return [tuple(r) for r in out]
