"""Best-fit packing by linear grouping.

Documents are cut into pieces of at most ``seq_len`` ids; pieces go into as
few sequences of ``seq_len`` ids as the scheme finds.

* Spark encodes the texts once and writes one small row per piece, counting
  each task's pieces of every length. The driver sees only the histogram of
  lengths: at most ``seq_len`` numbers, whatever the corpus.
* ``plan_packing`` works on that histogram. Large lengths are put in groups of equal cardinality and rounded up to the
  largest of their group, which leaves few sizes; the best mix of
  configurations (how many of each size share a sequence) is found by column
  generation, and its whole part is used. The actual pieces, longest first,
  take the slots of their group; what they leave free, and pieces the whole
  part did not place, go to best fit: each length, from the largest, into the
  sequences with the least room that still holds it. Equal sequences are
  handled as one run with a multiplicity, so the plan has a bounded number of
  runs, however many sequences it stands for.
* The plan maps (length, rank among the pieces of that length) to (sequence,
  offset). Ranks come from prefix sums of the tasks' counts.

Null text has no ids of its own, so its one piece is the end id. Ties (pieces
of one length) are placed by task and place in it. Repeated rows are documents
of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, written
from rollcall.llm.encode import encoder

SEQ_LEN = 2048
#: schemes tried on the histogram, the one with the fewest sequences is used:
#: (lengths over this share of a sequence are large, groups of equal
#: cardinality that they are rounded to)
SCHEMES = ((1 / 8, 48), (1 / 5, 96), (1 / 3, 128), (1 / 3, 192), (1 / 2, 64))
#: columns generated at most for the best mix of configurations
ROUNDS = 1200


# -- the plan, from a histogram of lengths ---------------------------------------

def _group_sizes(large: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Large (length, count), longest first, in groups of equal cardinality:
    (rounded-up size, members). A length can stand in two groups."""
    total = sum(n for _, n in large)
    each = max(1, -(-total // groups))
    out, members, room = [], [], each
    for length, n in large:
        while n:
            take = min(n, room)
            members.append((length, take))
            n, room = n - take, room - take
            if not room:
                out.append((members[0][0], members))
                members, room = [], each
    if members:
        out.append((members[0][0], members))
    merged: list[tuple[int, list]] = []
    for size, mem in out:               # groups of one size are one group
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(mem)
        else:
            merged.append((size, mem))
    return merged


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, cap: int) -> np.ndarray:
    """The configuration of most worth that fits: best worth within each
    capacity, one more item at a time."""
    best, took = [np.zeros(cap + 1)], []
    room = np.arange(cap + 1)[None, :] - sizes[:, None]
    fits = room >= 0
    for _ in range(cap // int(sizes.min())):
        vals = np.where(fits, best[-1][np.maximum(room, 0)] + worth[:, None], 0.0)
        pick = vals.argmax(0)
        value = vals[pick, np.arange(cap + 1)]
        if not (value > best[-1] + 1e-12).any():
            break
        took.append(np.where(value > best[-1] + 1e-12, pick, -1))
        best.append(np.maximum(value, best[-1]))
    config, c = np.zeros(len(sizes), dtype=np.int64), cap
    for pick in reversed(took):
        if pick[c] >= 0:
            config[pick[c]] += 1
            c -= sizes[pick[c]]
    return config


def configurations(sizes: list[int], need: list[int], cap: int, rounds: int = ROUNDS
                   ) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, so that every size is served
    ``need`` times with the least sequences, fractions allowed (column
    generation with a revised simplex)."""
    s, d = np.array(sizes), np.array(need, dtype=float)
    k = len(s)
    basis = np.diag(cap // s).astype(float)
    x = np.linalg.solve(basis, d)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        column = _best_configuration(s, worth, cap)
        if column @ worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        x = np.maximum(np.linalg.solve(basis, d), 0)
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(k)]


def plan_packing(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> tuple[np.ndarray, int]:
    """The scheme with the fewest sequences for a histogram of lengths; see
    ``scheme_plan``."""
    return min((scheme_plan(histogram, seq_len, small, groups) for small, groups in SCHEMES),
               key=lambda plan: plan[1])


def scheme_plan(histogram: dict[int, int], seq_len: int, small: float, groups: int
                ) -> tuple[np.ndarray, int]:
    """(runs, sequences). A run is (length, first rank, count, first sequence,
    offset): pieces first rank .. first rank + count - 1 of that length go to
    consecutive sequences, all at that offset."""
    used: dict[int, int] = defaultdict(int)         # ranks given out per length
    runs: list[tuple[int, int, int, int, int]] = []
    n_seq = 0
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)   # room -> (first sequence, count)
    levels: list[int] = []                          # rooms that exist, ascending

    def place(length: int, first: int, count: int, offset: int) -> None:
        runs.append((length, used[length], count, first, offset))
        used[length] += count

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if not rooms[room]:
                insort(levels, room)
            rooms[room].append((first, count))

    large = [(n, c) for n, c in sorted(histogram.items(), reverse=True) if c and n > seq_len * small]
    left: dict[int, int] = {n: c for n, c in histogram.items() if c and n <= seq_len * small}
    whole = [x for x in large if x[0] == seq_len]
    for length, count in whole:
        place(length, n_seq, count, 0)
        n_seq += count
    grouped = _group_sizes([x for x in large if x[0] < seq_len], groups)
    queue = [list(members) for _, members in grouped]
    sizes = [size for size, _ in grouped]
    found = configurations(sizes, [sum(c for _, c in m) for m in queue], seq_len) if sizes else []
    for config, times in found:
        todo = int(times + 1e-9)
        slots = [g for g in range(len(sizes)) for _ in range(config[g])]
        while todo > 0 and slots:
            # as many sequences as get the same lengths slot by slot
            take, lengths, heads = todo, [], defaultdict(int)
            for g in slots:
                heads[g] += 1
            picked: dict[int, list[int]] = {}
            for g, m in heads.items():
                if not queue[g]:
                    picked[g] = []
                    continue
                length, count = queue[g][0]
                if count >= m:
                    take = min(take, count // m)
                    picked[g] = [length] * m
                else:                                # the run ends within one sequence
                    take = 1
                    picked[g] = []
                    for length, count in queue[g]:
                        picked[g] += [length] * min(count, m - len(picked[g]))
                        if len(picked[g]) == m:
                            break
            if not any(picked.values()):
                break
            for g, got in picked.items():
                for length in got:
                    lengths.append(length)
                    queue[g][0] = (queue[g][0][0], queue[g][0][1] - take)
                    if not queue[g][0][1]:
                        queue[g].pop(0)
            offset = 0
            for length in sorted(lengths, reverse=True):
                place(length, n_seq, take, offset)
                offset += length
            leave(seq_len - offset, n_seq, take)
            n_seq, todo = n_seq + take, todo - take
    for members in queue:
        for length, count in members:
            left[length] = left.get(length, 0) + count
    # best fit, longest first, into the least room that holds the length
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect_left(levels, length)
            if at == len(levels):
                per = seq_len // length
                new = max(1, count // per)
                leave(seq_len, n_seq, new)
                n_seq += new
                at = bisect_left(levels, length)
            room = levels[at]
            first, have = rooms[room].pop()
            if not rooms[room]:
                levels.pop(at)
            take = min(have, count)
            place(length, first, take, seq_len - room)
            leave(room - length, first, take)
            leave(room, first + take, have - take)
            count -= take
    return np.array(runs, dtype=np.int64).reshape(-1, 5), n_seq


# -- Spark ------------------------------------------------------------------------

def pieces(docs: DataFrame, tokenizer_path: str, *, seq_len: int = SEQ_LEN, end_id: int | None = 0,
           id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, the writing
    ``task`` and the piece's ``rank`` among its task's pieces of that length;
    with ``keep_ids`` also its ids, packed unsigned 32-bit."""
    bounded_batches(docs.sparkSession)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType),
              T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType())
               for c in ("start", "length", "ids_crc32", "task", "rank")]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            source, number, start, length, crc, rank, kept = [], [], [], [], [], [], []
            for row, ids in enumerate(enc.ids(b.column(1))):
                ids += tail
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, seq_len)):
                    part = ids[4 * at:4 * (at + seq_len)]
                    size = len(part) // 4
                    source.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[size])
                    seen[size] += 1
                    kept.append(part)
            cols = [b.column(0).take(pa.array(source, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array([task] * len(source), pa.int64()),
                    pa.array(rank, pa.int64())]
            if keep_ids:
                cols.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, seq_len: int = SEQ_LEN,
                   end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text",
                   keep_ids: bool = False) -> DataFrame:
    """Every piece with the sequence it goes to: id, piece, start, length,
    ids_crc32, sequence_id, offset (and ids with ``keep_ids``)."""
    cut = written(pieces(docs, tokenizer_path, seq_len=seq_len, end_id=end_id, id_col=id_col,
                         text_col=text_col, keep_ids=keep_ids), "packing-pieces")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(by_task.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0))),
                    "packing-bases")
    histogram = {r["length"]: r["n"] for r in
                 bases.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most seq_len rows
    runs, _ = plan_packing(histogram, seq_len)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    plan = docs.sparkSession.sparkContext.broadcast(runs[order])
    ranked = cut.join(bases.drop("_n"), ["task", "length"])
    names = [id_col, "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    schema = T.StructType([cut.schema[c] for c in names]
                          + [T.StructField("sequence_id", T.LongType()),
                             T.StructField("offset", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        edge = 1 << 40                                     # ranks stay below
        keys = runs[:, 0] * edge + runs[:, 1]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy()
            at = np.searchsorted(keys, length * edge + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in names]
                + [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])],
                names=names + ["sequence_id", "offset"])

    return (ranked.select(*names, (F.col("_base") + F.col("rank")).alias("_rank"))
            .mapInArrow(assign, schema))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``pack_documents`` with ``keep_ids``):
    sequence_id, length, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), parts.alias("_p"))
            .select("sequence_id", "length",
                    F.aggregate("_p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids")))
