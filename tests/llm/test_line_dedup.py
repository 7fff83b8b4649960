import random
from collections import Counter

import pytest

from rollcall.llm import line_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def brute(rows, min_chars, min_docs, keep_first=False):
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")}
                if len(k) >= min_chars)
    many = {k for k, c in n.items() if c >= min_docs}
    out, seen = [], set()
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            k = key(x)
            if k not in many or (keep_first and k not in seen):
                kept.append(x)
            seen.add(k)
        out.append((i, len(lines), len(lines) - len(kept),
                    t if len(kept) == len(lines) else "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    common = ["License: MIT", "  license: mit\t", "É", "é", "x", "", " ", "Kelvin K", "漢字"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(400)}"
                          for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    return rows + [(900, None), (901, ""), (902, "\n\n"), (903, "y" * 30000 + "\nx")]


def collect(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_chars,min_docs,broadcast", [(1, 10, 1 << 20), (2, 2, 1 << 20), (1, 10, 0),
                                                          (5, 3, 0)])
def test_matches_brute_force(spark, monkeypatch, min_chars, min_docs, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)   # 0: by the join
    rows = rows_of(min_docs)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.dedup_lines(df, min_chars=min_chars, min_docs=min_docs)
    assert collect(got) == brute(rows, min_chars, min_docs)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_keep_first(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df, min_docs=2, keep_first=True)
    assert collect(got) == brute(rows, 1, 2, keep_first=True)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter far too small suspects every line; the count decides."""
    monkeypatch.setattr(line_dedup, "MIN_FILTER_BITS", 64)
    rows = rows_of(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_lines(df, min_docs=10, max_filter_bits=64)
    assert collect(got) == brute(rows, 1, 10)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_clashing_columns_null_ids_and_empty(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    rows = [(None, "a\nb", 1, "k"), (None, "a\nb", 2, "k"), (3, "a", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, _key string")
    got = line_dedup.dedup_lines(df, min_docs=3)
    assert sorted((r.text, r.n_lines, r.n_dropped, r._key) for r in got.collect()
                  if r.doc_id is None) == [("b", 2, 1, "k")] * 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_twice_filter_misses_no_repeated_key_and_few_others_pass(spark, monkeypatch, held):
    """Filters of blocks of ``held`` lines, sparse and dense parts, merged."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    rng = random.Random(held)
    keys = [f"line {i}" for i in range(9000)]
    rows = [(i, "\n".join(rng.sample(keys[:500], 6) + keys[500 + 20 * i:520 + 20 * i])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed = line_dedup.twice_filter(df, "text", 1, line_dedup.MIN_FILTER_BITS)
    n = Counter(k for _, t in rows for k in set(t.split("\n")))
    passed = {k.decode() for k in line_dedup._suspected([k.encode() for k in n], packed, 1)}
    repeated = {k for k, c in n.items() if c > 1}
    assert repeated <= passed
    assert len(passed - repeated) <= 0.02 * len(n)


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 60000])
def test_filter_parts_round_trip(n):
    import numpy as np
    slots = np.sort(np.random.default_rng(n).choice(3 << 16, n, replace=False)).astype(np.uint64)
    parts = line_dedup._parts(slots, 1 << 16)
    back = [p * (1 << 16) + x for p, b in parts.items() for x in line_dedup._places(b, 1 << 16).tolist()]
    assert back == slots.tolist()
    assert all(len(b) <= 8192 for b in parts.values())
