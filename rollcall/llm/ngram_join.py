"""N-gram Jaccard join by prefix tree.

A document's set is its distinct n-grams of words (``words`` each; with fewer
words, the whole sequence as one), as 64-bit hashes. Two documents link when
den * |intersection| >= num * |union|. Links and components are exact:

1. Support. A linked document shares all but (1 - num/den) of its set with its
   partner. Over the quarter of all hashes below 2^62 (all hashes of short
   texts) one shuffle finds which occur in another document
   (``repeats.repeated_hashes``). A document with too few of those has no
   partner and is out, as are nearly all.
2. Equal sets become one representative row with its sorted set.
3. Hashes of the representatives are counted. In the global order (rarest
   first, then by hash) two linked sets share a hash within their prefixes, so
   sets that share none never meet. Hashes of one set cannot meet anything.
4. Sets joined by shared prefix hashes form a cluster; its sets are sent once,
   to one task, or beyond ``BLOCK`` sets to one task per pair of blocks, so no
   task holds more than two blocks.
5. In a task the sets lie in a trie, ordered most frequent hash first so that
   near copies share long paths: a sorted list with common-prefix lengths. A
   set is walked against the others it shares a prefix hash with; the overlap
   so far is kept for the shared part of the path, and a subtree ends where
   what remains cannot reach the needed overlap. Sets already linked to the
   walking one, directly or through others, need no walk: the task returns
   the links that hold its groups together.

Null texts and texts without words have an empty set and no link. A document
whose id is null takes part; it gets the least id of its group. ``component_id``
is the least id of the group; ties cannot arise between ids, and of rows with
equal id and text one is kept. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, fresh, row_key, schema_with, written
from rollcall.llm.components import components
from rollcall.llm.repeats import LOW, repeated_hashes
from rollcall.llm.words import Words, constants, mix, string_slices

#: texts with at most this many n-grams are tested with all of them
SHORT = 64
#: sets a task takes on each side
BLOCK = 4_000
#: bytes of text whose n-grams one part of the support step owns
PART_BYTES = 16 << 20


def text_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of every text."""
    for _, data, offsets in string_slices(texts):
        w = Words(data, offsets, fold=True)
        hashes = w.hashes()
        at, grams = w.ngrams(hashes, words)
        rows = w.row[at]
        cut = np.searchsorted(rows, np.arange(w.rows + 1))
        first = w.first()
        for r in range(w.rows):
            if cut[r + 1] > cut[r]:
                yield np.unique(grams[cut[r]:cut[r + 1]])
            elif first[r + 1] > first[r]:      # fewer words than an n-gram
                held = hashes[first[r]:first[r + 1]]
                yield mix(np.array([np.sum(held * constants(len(held), 53 + len(held)))]))
            else:
                yield np.zeros(0, dtype=np.uint64)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                       words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``docs`` with ``n_shingles`` (size of the set), ``component_id`` and
    ``keep`` (true for one row of each group: the one with the least id)."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    keyed = docs.select(row_key(id_col, text_col).alias("_key"), F.col(id_col).alias("_id"),
                        F.col(text_col).alias("_text"))
    table = written(_sized(keyed, id_type, words, num, den), "ngram-rows")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0

    def probes(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for key, s in zip(b.column(0).to_pylist(), text_sets(b.column(1), words)):
            # a partner of a short text has at most SHORT * den / num n-grams
            yield key, s if len(s) * num <= SHORT * den else _low(s)

    found = repeated_hashes(keyed.select("_key", "_text"), max(64, total // PART_BYTES), probes)
    support = found.groupBy(F.col("key").alias("_key")).agg(
        F.sum("n_found").alias("_all"), F.sum("n_low").alias("_low"))
    have = F.coalesce(F.when(F.col("_n") <= SHORT, F.col("_all")).otherwise(F.col("_low")), F.lit(0))
    # equal sets: one representative, named by the least of its row keys
    reps = (table.where("_n > 0").join(support, "_key", "left").where(have >= F.col("_need"))
            .groupBy("_digest").agg(F.min("_key").alias("_key"), F.min("_n").alias("_n")))
    reps = written(reps, "ngram-reps")
    groups = _groups(reps, keyed, words, num, den)
    # every row's group: the digest of its representative's component, or its own
    linked = written(reps.join(groups, F.col("_key") == F.col("node"))
                     .select("_digest", F.col("component").alias("_group")), "ngram-linked")
    alone = F.when(F.col("_n") > 0, F.xxhash64("_digest")).otherwise(F.col("_key"))
    tag = F.when(F.col("_group").isNotNull(), F.lit("group")).when(F.col("_n") > 0, F.lit("set")
                                                                   ).otherwise(F.lit("row"))
    rows = (table.join(linked, "_digest", "left")
            .select("_key", "_id", "_n", tag.alias("_tag"),
                    F.coalesce("_group", alone).alias("_group")))
    rows = written(rows, "ngram-grouped")
    least = (rows.where(F.col("_tag") != "row").groupBy("_tag", "_group")
             .agg(F.min("_id").alias("_least"), F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))
                  ["_key"].alias("_first")))
    done = (rows.join(written(least, "ngram-least"), ["_tag", "_group"], "left")
            .groupBy("_key").agg(F.min("_n").alias("n_shingles"),
                                 F.min(F.coalesce("_least", "_id")).alias("component_id"),
                                 F.min(F.coalesce("_first", "_key")).alias("_first")))
    out = schema_with(docs, T.StructField("n_shingles", T.LongType()),
                      T.StructField("component_id", id_type), T.StructField("keep", T.BooleanType()))
    order = [f.name for f in out.fields[:-3]]
    key = fresh(docs, "_key")
    first = fresh(docs, "_first")
    done = written(done, "ngram-done").withColumnsRenamed({"_key": key, "_first": first})
    rows = docs.select(*order, *({id_col, text_col} - set(order)), row_key(id_col, text_col).alias(key))
    # rows equal in id and text share a key: one of them is kept
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return rows.join(done, key).select(
        *order, "n_shingles", "component_id", ((F.col(key) == F.col(first)) & (nth == 1)).alias("keep"))


def _low(s: np.ndarray) -> np.ndarray:
    """The hashes below 2^62 of a sorted set: a fixed quarter of all hashes."""
    return s[:int(np.searchsorted(s, LOW))]


def _sized(keyed: DataFrame, id_type: T.DataType, words: int, num: int, den: int) -> DataFrame:
    """Per row: key, id, set size, digest of the set, and how many of the hashes
    of the support test must occur elsewhere."""
    schema = T.StructType([
        T.StructField("_key", T.LongType()), T.StructField("_id", id_type),
        T.StructField("_n", T.LongType()), T.StructField("_digest", T.BinaryType()),
        T.StructField("_need", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, need = [], [], []
            for s in text_sets(b.column(2), words):
                n = len(s)
                tested = n if n <= SHORT else len(_low(s))
                size.append(n)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                need.append(tested - (n * (den - num)) // den)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(need, pa.int64())],
                names=[f.name for f in schema])

    return keyed.mapInArrow(run, schema)


def _groups(reps: DataFrame, keyed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, component) of representatives with a link."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(text_sets(b.column(1), words))
            off = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))],
                names=["_key", "_set"])

    texts = keyed.join(reps.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    full = written(texts.select("_key", "_text").mapInArrow(sets, "_key long, _set array<long>"),
                   "ngram-sets")
    tokens = full.select("_key", F.explode("_set").alias("_t"))
    shared = written(tokens.groupBy("_t").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1"),
                     "ngram-shared")
    # rarest first; a set's own hashes come before all shared ones
    ordered = (tokens.join(shared, "_t").groupBy("_key")
               .agg(F.array_sort(F.collect_list(F.struct("_df", "_t"))).alias("_s")))
    n, own = F.col("_n"), F.col("_n") - F.size("_s")
    prefix = n - F.ceil(n * num / den) + 1 - own
    known = written(ordered.join(reps.select("_key", "_n"), "_key").where(prefix > 0)
                    .withColumn("_p", F.least(prefix, F.size("_s")).cast("int")), "ngram-ordered")
    heads = written(known.select("_key", F.explode(F.slice("_s", F.lit(1), F.col("_p"))).alias("_h"))
                    .select("_key", F.col("_h._t").alias("_t")), "ngram-heads")
    least = heads.groupBy("_t").agg(F.min("_key").alias("_m"), F.count(F.lit(1)).alias("_c"))
    met = heads.join(written(least.where("_c > 1"), "ngram-met"), "_t")
    clusters = written(components(met.select(F.col("_key").alias("a"), F.col("_m").alias("b"))),
                       "ngram-clusters")
    return components(_cluster_links(known, clusters, num, den))


def _cluster_links(known: DataFrame, clusters: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that hold the groups of each cluster together."""
    sizes = written(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("_c")),
                    "ngram-cluster-sizes")
    blocks = F.ceil(F.col("_c") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64(F.col("_key"), F.lit(7)), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    sent = (known.join(clusters.withColumnRenamed("node", "_key"), "_key")
            .join(sizes, "component").withColumn("_blocks", blocks).withColumn("_mine", mine)
            .withColumn("_other", other)
            .select(F.col("component").alias("_cluster"),
                    F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"),
                    "_mine", "_key", "_n", "_p", F.col("_s._df").alias("_df"), F.col("_s._t").alias("_t")))

    def join(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        i, j = t["_i"][0].as_py(), t["_j"][0].as_py()
        keys = t["_key"].to_numpy()
        token = [np.asarray(x.values) for x in t["_t"]]
        freq = [np.asarray(x.values) for x in t["_df"]]
        links = trie_links(keys, t["_n"].to_numpy(), t["_p"].to_numpy(), token, freq, num, den,
                           None if i == j else t["_mine"].to_numpy())
        a, b = (np.array([x[k] for x in links], dtype=np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return sent.groupBy("_cluster", "_i", "_j").applyInArrow(join, "a long, b long")


def trie_links(keys: np.ndarray, sizes: np.ndarray, prefixes: np.ndarray,
               tokens: list[np.ndarray], freqs: list[np.ndarray], num: int, den: int,
               side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the sets of one task, enough to connect every pair that
    links (with ``side``: only pairs of different sides are walked).

    ``tokens``: each set's shared hashes, rarest first, of which the first
    ``prefixes`` are its prefix; ``freqs`` their counts; ``sizes`` the sizes of
    the whole sets, with hashes that no other set has."""
    n = len(keys)
    if n < 2:
        return []
    flat = np.concatenate(tokens)
    count = np.concatenate(freqs)
    # ranks in the order of the trie: most frequent first, then by hash
    distinct, first, which = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(distinct), dtype=np.int64)
    rank[np.lexsort((distinct, -count[first]))] = np.arange(len(distinct))
    ranks = rank[which]
    cut = np.concatenate(([0], np.cumsum([len(x) for x in tokens])))
    heads = [ranks[cut[i]:cut[i] + prefixes[i]].tolist() for i in range(n)]
    paths = [np.sort(ranks[cut[i]:cut[i + 1]]).tolist() for i in range(n)]
    order = sorted(range(n), key=paths.__getitem__)
    paths = [paths[i] for i in order]
    heads = [heads[i] for i in order]
    size = [int(sizes[i]) for i in order]
    key = [int(keys[i]) for i in order]
    half = None if side is None else [int(side[i]) for i in order]
    # common[i]: length of the path that set i shares with the one before it
    common = [0] * n
    for i in range(1, n):
        a, b = paths[i - 1], paths[i]
        d, stop = 0, min(len(a), len(b))
        while d < stop and a[d] == b[d]:
            d += 1
        common[i] = d
    group = np.arange(n)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    # prefix hash -> sets with it, listed by the group they were in when added,
    # so that the sets of a known group are passed over together
    postings: dict[int, dict[int, list[int]]] = defaultdict(dict)
    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        links.append((key[i], key[j]))
        a, b = int(group[i]), int(group[j])
        if a == b:
            return
        if len(members[a]) < len(members[b]):
            a, b = b, a
        group[members[b]] = a
        members[a] += members.pop(b)

    def walk(i: int, met: np.ndarray) -> None:
        """Down the trie over the leaves met, in their order."""
        q, m = paths[i], size[i]
        state: list[tuple[int, int]] = [(0, 0)]   # per depth: overlap, place in q
        last = -1
        for j in met.tolist():
            if group[j] == group[i] or (half is not None and half[j] == half[i]):
                continue
            s = size[j]
            if s * den < num * m or m * den < num * s:
                continue
            need = -(-num * (m + s) // (num + den))
            if last >= 0:
                del state[min(common[last + 1:j + 1]) + 1:]
            path = paths[j]
            d = len(state) - 1
            overlap, at = state[d]
            last = j
            end, stop = len(q), len(path)
            while d < stop and overlap + min(stop - d, end - at) >= need:
                t = path[d]
                while at < end and q[at] < t:
                    at += 1
                if at < end and q[at] == t:
                    overlap += 1
                    at += 1
                d += 1
                state.append((overlap, at))
            if overlap >= need:
                link(i, j)

    for i in range(n):
        q, m = paths[i], size[i]
        if i and (half is None or half[i] != half[i - 1]):
            if _reach(q, paths[i - 1], m, size[i - 1], num, den):   # the nearest leaf first
                link(i, i - 1)
        mine = group[i]
        met = {j for t in heads[i] for held in postings[t].values() if group[held[0]] != mine
               for j in held}
        if met:
            walk(i, np.array(sorted(met)))
        for t in heads[i]:
            postings[t].setdefault(int(group[i]), []).append(i)
    return links


def _reach(a: list[int], b: list[int], n: int, m: int, num: int, den: int) -> bool:
    shared = len(set(a).intersection(b))
    return den * shared >= num * (n + m - shared)
