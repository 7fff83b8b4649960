"""Vector codes: the dual-tree walk and the whole compression against plain
Lloyd by all distances."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from rollcall.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_walk_finds_the_nearest_entry_of_every_part():
    rng = np.random.default_rng(0)
    for t in range(200):
        n, d, k = int(rng.integers(1, 600)), int(rng.integers(1, 6)), int(rng.integers(1, 65))
        r = int(rng.choice([1, 3, 60, 30_000, V.LIMIT]))      # ties, and all widths
        x = rng.integers(-r, r + 1, (n, d))
        e = x[rng.integers(0, n, k)] if t % 2 else rng.integers(-r, r + 1, (k, d))
        far = ((x[:, None] - e[None]) ** 2).sum(2)
        grown = V.Tree.grow(x, V.LEAF)
        tree, book = V.Books(e[None]).fitting(0, V.Tree.unpacked(n, grown.packed(), V.LEAF))
        number, error = V.codes(tree, book)
        assert (number == far.argmin(1)).all() and (error == far.min(1)).all()
        want = np.zeros((k, d + 1), np.int64)
        np.add.at(want[:, :d], far.argmin(1), x)
        np.add.at(want[:, d], far.argmin(1), 1)
        assert (V.entry_sums(tree, book) == want).all()


def test_bounds_prune_and_assign_whole_nodes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (64, 4))
    x = centres[rng.integers(0, 64, 20_000)] + rng.integers(-9, 10, (20_000, 4))
    tree, book = V.Books(centres[None]).fitting(0, V.Tree.grow(x, V.LEAF))
    whole, (member, _) = V.walk(tree, book)
    assert sum(len(node) for _, node, _ in whole) < 2000       # nodes, for nearly all parts
    assert len(member) < 2000


def plain(rows):
    """Codes, errors, label errors and digest from (id, vector, label) rows."""
    kept = [(i, v, lab) for i, v, lab in rows
            if v is not None and v and len(v) % 16 == 0
            and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([[max(min(math.floor(256 * c), V.LIMIT), -V.LIMIT) for c in v] for _, v, _ in kept])
    parts = x.reshape(len(kept), 16, -1)
    books = [parts[:64, p].copy() for p in range(16)]

    def near(p):
        far = ((parts[:, p][:, None] - books[p][None]) ** 2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(2):
        for p in range(16):
            number, _ = near(p)
            for e in range(len(books[p])):
                own = parts[number == e, p]
                if len(own):
                    books[p][e] = own.sum(0) // len(own)
    found = [near(p) for p in range(16)]
    code = ["".join(f"{found[p][0][i]:02x}" for p in range(16)) for i in range(len(kept))]
    error = [int(sum(found[p][1][i] for p in range(16))) for i in range(len(kept))]
    label = {}
    for (_, _, lab), e in zip(kept, error):
        label[lab] = label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for row in b for c in row).encode()).hexdigest()
    return sorted(((-1 if i is None else i), c, e, label[lab])
                  for (i, _, lab), c, e in zip(kept, code, error)), digest


def result(df):
    coded, books = V.compress(df)
    out = V.with_label_errors(coded)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.code, r.error, r.label_error)
                  for r in out.collect()), V.digest(books)


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [[float(c) for c in row] for row in (rng.normal(size=(n, dim)) * scale).astype(np.float32)]


def test_compress_equals_plain_lloyd(spark):
    vs = vectors(700, 32, 2)
    vs += vs[:150]                                   # copies: ties everywhere
    rows = [(5 * i % 853, v, i % 7 or None) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == plain(rows)


def test_rows_that_cannot_be_coded_go(spark):
    good = vectors(90, 16, 3)
    rows = [(i, v, 1) for i, v in enumerate(good)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [1.0] * 15, 1), (-2, [float("nan")] * 16, 1),
             (-1, [float("inf")] + [0.0] * 15, 2), (200, [None] + [0.0] * 15, 2), (201, [0.5] * 32, 2),
             (None, [1.0] * 16, None), (None, [2.0] * 16, None), (7, good[7], 3), (7, good[8], 3)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_few_vectors_huge_components_and_other_columns(spark):
    rows = [(3, [1e30] * 16, 1), (1, [-1e30] * 16, None), (2, [100_000.0] * 16, 1), (9, [0.25] * 16, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == plain(rows)
    clash = df.withColumns({c: F.lit("x") for c in ("code", "error", "label_error", "_label", "ids", "at")})
    assert result(clash) == plain(rows)


def test_empty_table(spark):
    for rows in ([], [(1, None, 2), (2, [1.0] * 5, 2)]):
        coded, books = V.compress(spark.createDataFrame(rows, SCHEMA))
        assert coded.collect() == [] and books.size == 0
        assert V.with_label_errors(coded).collect() == []


def test_blocks_do_not_show(spark, monkeypatch):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(400, 16, 4))]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(V, "BLOCK", 16 * 64)
    assert result(df.coalesce(1)) == plain(rows)
