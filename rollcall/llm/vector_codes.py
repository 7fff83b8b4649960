"""Vector codes by dual-tree Lloyd.

Each component x of a vector becomes the integer floor(256 * x); a vector is cut
into 16 equal parts, and each part is coded as the number of the nearest entry
of its position's codebook, which two rounds of Lloyd's algorithm improve.

A task takes vectors in blocks. Over each position's parts of a block it grows
a tree once: halves by the median of the widest component, down to leaves of
some 16 parts, with the box, the sum and the count of every node. These trees
are a table in the shared folder that each round reads. A second tree stands
over the codebook's entries. A round walks both trees together, as pairs of a
node of parts and a node of entries. The least and the greatest squared distance
between the two boxes bound all distances between their members, so a pair whose
least distance exceeds the greatest distance of another pair of the same node
holds no nearest entry and goes, with all combinations below it; of single
entries those go too that lie farther than another one from every point of the
node's box. A node left with one entry is assigned as a whole, by its cached sum and count. Leaves that
stay uncertain compare their parts with the entries left to them. Boxes, sums
and distances are integers, so nothing is approximate; of entries equally near
the lower index wins (of equal entries only the lowest can).

The driver holds one codebook (16 x 64 entries) and what the tasks' sums add
up to, which does not grow with the table. Nothing is shuffled but these sums
and the errors of each label.

Defined results: vectors that are null, hold a null or non-finite component or
whose length is not the common one go. The common length is that of the usable
vector of the least vec_id (null ids last, then by vector), where usable includes
a length of 16, 32, ... . Fewer than 64 vectors make a codebook of so many
entries. Rows equal in vec_id are coded each. Components beyond 2^26 / 256 in
size count as that limit, so that squares fit 64 bits. An empty table gives an
empty table; other columns stay out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StringType, StructField,
                               StructType)

from rollcall.llm.common import bounded_batches, written
from rollcall.session import scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: largest component kept as it is
LIMIT = 1 << 26
#: parts in a leaf, entries in a lowest node of the entries' tree
LEAF, FEW = 16, 4
#: components of a block of vectors
BLOCK = 1 << 20
_ROW_GROUP = 16 << 20


# -- trees -----------------------------------------------------------------------

def _edges(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin and end, for n members: halves until
    no node has more than ``leaf``."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        e = levels[-1]
        out = np.empty(2 * len(e) - 1, np.int64)
        out[::2], out[1::2] = e, (e[:-1] + e[1:]) // 2
        levels.append(out)
    return levels


class Tree:
    """Members in tree order and, level by level, the nodes' boxes and sums."""

    def __init__(self, points: np.ndarray, order: np.ndarray, lo, hi, sums, leaf: int):
        self.points, self.order = points, order
        self.edges = _edges(len(points), leaf)
        self.lo, self.hi, self.sums = lo, hi, sums

    def largest(self) -> int:
        return int(max(abs(self.lo[0]).max(), abs(self.hi[0]).max()))

    def of(self, width: type) -> Tree:
        """The same tree with components of another integer type."""
        self.points = self.points.astype(width)
        self.lo, self.hi = [a.astype(width) for a in self.lo], [a.astype(width) for a in self.hi]
        return self

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int) -> Tree:
        order = np.arange(len(points))
        levels = _edges(len(points), leaf)
        lo, hi, sums = [], [], []
        for depth, e in enumerate(levels):
            lo.append(np.minimum.reduceat(points, e[:-1]))
            hi.append(np.maximum.reduceat(points, e[:-1]))
            sums.append(np.add.reduceat(points, e[:-1], dtype=np.int64))
            if depth + 1 < len(levels):
                node = np.repeat(np.arange(len(e) - 1), np.diff(e))
                widest = (hi[-1] - lo[-1]).argmax(axis=1)
                by = np.lexsort((points[np.arange(len(points)), widest[node]], node))
                points, order = points[by], order[by]
        return cls(points, order, lo, hi, sums, leaf)

    def packed(self) -> tuple[bytes, ...]:
        return (self.points.astype("<i4").tobytes(), self.order.astype("<u4").tobytes(),
                np.concatenate(self.lo).astype("<i4").tobytes(),
                np.concatenate(self.hi).astype("<i4").tobytes(),
                np.concatenate(self.sums).astype("<i8").tobytes())

    @classmethod
    def unpacked(cls, n: int, raw: tuple[bytes, ...], leaf: int) -> Tree:
        points = np.frombuffer(raw[0], "<i4").reshape(n, -1)
        cuts = np.cumsum([len(e) - 1 for e in _edges(n, leaf)])[:-1]
        lo, hi, sums = (np.split(np.frombuffer(b, t).reshape(-1, points.shape[1]), cuts)
                        for b, t in zip(raw[2:], ("<i4", "<i4", "<i8")))
        return cls(points, np.frombuffer(raw[1], "<u4").astype(np.int64), lo, hi, sums, leaf)


class Codebook:
    """A position's entries and the tree over them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        _, first = np.unique(entries, axis=0, return_index=True)
        self.index = np.sort(first)              # of equal entries the lowest
        self.tree = Tree.grow(entries[self.index], FEW)
        #: boxes per level, the entries themselves last
        self.lo = [*self.tree.lo, self.tree.points]
        self.hi = [*self.tree.hi, self.tree.points]

    def below(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First member of the next level below each node, and how many."""
        if level + 2 < len(self.lo):
            return 2 * node, np.full(len(node), 2)
        e = self.tree.edges[-1]
        return e[node], e[node + 1] - e[node]

    def numbers(self, member: np.ndarray) -> np.ndarray:
        return self.index[self.tree.order[member]]


class Books:
    """The codebooks in a task, each in the integer types its trees ask for."""

    def __init__(self, books: np.ndarray):
        self.books, self.made = books, {}

    def fitting(self, p: int, tree: Tree) -> tuple[Tree, Codebook]:
        entries = self.books[p]
        width = _width(max(tree.largest(), int(abs(entries).max())), entries.shape[1])
        if (p, width) not in self.made:
            self.made[p, width] = Codebook(entries.astype(width))
        return tree.of(width), self.made[p, width]


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each, one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _width(largest: int, dim: int) -> type:
    """Integers in which no distance or bound of such components overflows."""
    return np.int32 if 16 * dim * largest * largest < 1 << 31 else np.int64


def walk(tree: Tree, book: Codebook) -> tuple[list, tuple]:
    """The nearest entries of a tree's members: whole nodes, as (level, nodes,
    entries), and uncertain members, as (members, entries)."""
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth, level = 0, 0
    bottom, last = len(tree.edges) - 1, len(book.lo) - 1
    whole = []
    while True:
        lo, hi = tree.lo[depth][node], tree.hi[depth][node]
        lo2, hi2 = book.lo[level][other], book.hi[level][other]
        gap = np.maximum(np.maximum(lo - hi2, lo2 - hi), 0)
        span = np.maximum(hi - lo2, hi2 - lo)
        least, most = _squares(gap), _squares(span)
        # pairs of a node stand together
        at = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        sizes = np.diff(np.append(at, len(node)))
        stay = least <= np.repeat(np.minimum.reduceat(most, at), sizes)
        node, other = node[stay], other[stay]
        if level == last:
            stay = _undominated(tree.lo[depth][node], tree.hi[depth][node], node, most[stay],
                                book.tree.points[other])
            node, other = node[stay], other[stay]
            at = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            sizes = np.diff(np.append(at, len(node)))
            alone = np.repeat(sizes == 1, sizes)
            whole.append((depth, node[alone], book.numbers(other[alone])))
            node, other = node[~alone], other[~alone]
            if depth == bottom or not len(node):
                return whole, _settle(tree, book, node, other)
        if level < last:
            first, count = book.below(level, other)
            node, other = np.repeat(node, count), _ragged(first, count)
            level += 1
        if depth < bottom:
            # both children of a node, each with all of the node's pairs
            at = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            sizes = np.diff(np.append(at, len(node)))
            pick = _ragged(np.repeat(at, 2), np.repeat(sizes, 2))
            child = np.stack((2 * node[at], 2 * node[at] + 1), axis=1).ravel()
            node, other = np.repeat(child, np.repeat(sizes, 2)), other[pick]
            depth += 1


def _undominated(lo, hi, node, most, entry) -> np.ndarray:
    """Pairs of a node and an entry but for those whose entry is farther from
    all of the node's box than the entry with the least greatest distance: the
    difference of the two squared distances is linear, so a corner bounds it."""
    at = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes = np.diff(np.append(at, len(node)))
    of = np.repeat(np.arange(len(at)), sizes)
    hit = np.flatnonzero(most == np.minimum.reduceat(most, at)[of])
    lead = entry[hit[np.searchsorted(of[hit], np.arange(len(at)))]][of]
    slope = 2 * (entry - lead)
    most_gain = np.where(slope > 0, slope * hi, slope * lo) + lead * lead - entry * entry
    return most_gain.sum(axis=1) >= 0


def _settle(tree: Tree, book: Codebook, node: np.ndarray, other: np.ndarray) -> tuple:
    """Members of uncertain leaves against the entries left to them."""
    if not len(node):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    entry = book.numbers(other)
    by = np.lexsort((entry, node))               # ties go to the lower number
    node, entry = node[by], entry[by]
    at = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes = np.diff(np.append(at, len(node)))
    e = tree.edges[-1]
    held = e[node[at] + 1] - e[node[at]]
    member = _ragged(e[node[at]], held)
    first, count = np.repeat(at, held), np.repeat(sizes, held)
    pair = _ragged(first, count)
    diff = tree.points[np.repeat(member, count)] - book.entries[entry[pair]]
    far = _squares(diff)
    starts = np.cumsum(count) - count
    hit = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, starts), count))
    of = np.repeat(np.arange(len(member)), count)[hit]
    hit = hit[np.concatenate(([True], of[1:] != of[:-1]))]
    return member, entry[pair[hit]]


def entry_sums(tree: Tree, book: Codebook) -> np.ndarray:
    """Per entry, the sum of its members and their number (last column)."""
    k, d = book.entries.shape
    out = np.zeros((k, d + 1), np.int64)
    whole, (member, entry) = walk(tree, book)
    for depth, node, number in whole:
        np.add.at(out[:, :d], number, tree.sums[depth][node])
        np.add.at(out[:, d], number, np.diff(tree.edges[depth])[node])
    np.add.at(out[:, :d], entry, tree.points[member])
    np.add.at(out[:, d], entry, 1)
    return out


def codes(tree: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Entry number and squared distance of each member, in source order."""
    found = np.empty(len(tree.points), np.int64)
    whole, (member, entry) = walk(tree, book)
    for depth, node, number in whole:
        e = tree.edges[depth]
        size = e[node + 1] - e[node]
        found[_ragged(e[node], size)] = np.repeat(number, size)
    found[member] = entry
    diff = tree.points - book.entries[found]
    out, far = np.empty_like(found), np.empty_like(found)     # 64 bits
    out[tree.order], far[tree.order] = found, _squares(diff)
    return out, far


# -- tables ----------------------------------------------------------------------

def usable(vector: str | Column) -> Column:
    """Vectors without null and non-finite components that 16 parts divide."""
    v = F.col(vector) if isinstance(vector, str) else vector
    def fine(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & F.forall(v, fine),
                      F.lit(False))


def integers(rows: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(rows.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _first_vectors(kept: DataFrame, id_col: str, vector: str) -> list:
    """The vectors of the 64 least ids that have the least one's length."""
    order = [F.col(id_col).asc_nulls_last(), F.col(vector).asc()]
    rows = kept.select(id_col, vector).orderBy(*order).limit(ENTRIES).collect()
    if any(len(r[1]) != len(rows[0][1]) for r in rows):
        same = kept.where(F.size(vector) == len(rows[0][1]))
        rows = same.select(id_col, vector).orderBy(*order).limit(ENTRIES).collect()
    return [r[1] for r in rows]


_TREE = ("points", "order", "lo", "hi", "sums")


def _tree_table(kept: DataFrame, id_col: str, vector: str, label: str, dim: int) -> DataFrame:
    """One row per block: ids, labels and the 16 trees of its vectors."""
    types = {f.name: f.dataType for f in kept.schema.fields}
    schema = StructType([StructField("ids", ArrayType(types[id_col])),
                         StructField("labels", ArrayType(types[label])),
                         *[StructField(f"{t}{p}", BinaryType()) for p in range(PARTS) for t in _TREE]])
    rows = max(64, BLOCK // dim)

    def block(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables).combine_chunks()
        ids, labels = table.column(0).combine_chunks(), table.column(2).combine_chunks()
        vectors = table.column(1).combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        ints = integers(flat).reshape(len(ids), PARTS, dim // PARTS)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [one(ids), one(labels)]
        for p in range(PARTS):
            columns += [pa.array([raw], pa.binary()) for raw in Tree.grow(ints[:, p], LEAF).packed()]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, rows - n)
                batch = batch.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    out = kept.where(F.size(vector) == dim).select(id_col, vector, label).mapInArrow(blocks, schema)
    path = scratch_path(kept.sparkSession, "vector-trees")
    # a reader holds one row group at a time
    out.write.option("parquet.block.size", str(_ROW_GROUP)).parquet(path)
    return kept.sparkSession.read.schema(schema).parquet(path)


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[int, list[Tree]]]:
    for i in range(batch.num_rows):
        n = len(batch.column(0)[i])
        yield i, [Tree.unpacked(n, tuple(batch.column(f"{t}{p}")[i].as_py() for t in _TREE), LEAF)
                  for p in range(PARTS)]


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    k, d = books.shape[1:]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Books(books)
        total = np.zeros((PARTS, k, d + 1), np.int64)
        for batch in batches:
            for _, grown in _trees(batch):
                for p in range(PARTS):
                    total[p] += entry_sums(*made.fitting(p, grown[p]))
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "value"])

    rows = (trees.mapInArrow(sums, "at long, value long").groupBy("at")
            .agg(F.sum("value").alias("value")).collect())
    total = np.zeros(PARTS * k * (d + 1), np.int64)
    for r in rows:
        total[r["at"]] = r["value"]
    total = total.reshape(PARTS, k, d + 1)
    count = total[:, :, d:]
    return np.where(count > 0, total[:, :, :d] // np.maximum(count, 1), books)


def _assigned(trees: DataFrame, books: np.ndarray, id_col: str, label: str) -> DataFrame:
    id_type = trees.schema["ids"].dataType.elementType
    label_type = trees.schema["labels"].dataType.elementType
    schema = StructType([StructField(id_col, id_type), StructField(label, label_type),
                         StructField("code", StringType()), StructField("error", LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Books(books)
        for batch in batches:
            for i, grown in _trees(batch):
                found, far = zip(*(codes(*made.fitting(p, t)) for p, t in enumerate(grown)))
                digits = np.stack(found, axis=1).astype(np.uint8).tobytes().hex()
                n = len(found[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values,
                     pa.array([digits[2 * PARTS * j:2 * PARTS * (j + 1)] for j in range(n)]),
                     pa.array(np.sum(far, axis=0))], names=schema.names)

    return trees.mapInArrow(assign, schema)


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
             label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every usable vector, and the codebooks
    (part, entry, component) the codes refer to."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    kept = embeddings.select(id_col, vector, label).where(usable(vector))
    first = _first_vectors(kept, id_col, vector)
    if not first:
        empty = kept.select(id_col, label, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.where(F.lit(False)), np.zeros((PARTS, 0, 1), np.int64)
    dim = len(first[0])
    books = integers(np.array(first)).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    trees = _tree_table(kept, id_col, vector, label, dim)
    for _ in range(ROUNDS):
        books = _round(trees, books)
    return _assigned(trees, books, id_col, label), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with the error summed over all rows of the same label (rows
    without one together). The sums are a written table, so a hot label is an
    ordinary skewed or broadcast join."""
    coded = written(coded, "vector-codes")
    sums = written(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")),
                   "vector-labels")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
