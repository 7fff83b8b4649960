import random
import re

import pytest
from pyspark.sql import functions as F

from rollcall.llm import decontam

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, window):
    pats = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            pats.setdefault(tuple(w[k:k + window]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for p, ids in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    named |= ids
        out[d] = (len(w), len(hit), sorted(map(str, named)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def cases(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "Straße", "É", "漢", "x1", "a'b", "c-d"]

    def text(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 9))) for i in range(25)] + [(90, None), (91, "?!"), (92, "a b")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(900, None), (901, "")]
    docs += [(902, items[3][1] + " " + items[4][1]), (903, "word " * 5000 + items[5][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_matches_brute_force(spark, block_bytes):
    docs, items = cases(block_bytes)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(df, bench, window=4, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in got} == brute(docs, items, 4)
    text = dict(docs)
    for r in got:   # the spans hold exactly the hit words
        assert sum(len(words(text[r.doc_id][s.start:s.end])) for s in r.spans) == r.n_hit


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "a", 6)],
                               "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(None, "a b"), (7, "A, B")], "item_id long, text string")
    got = sorted((r.n_hit, tuple(r.items)) for r in decontam.decontaminate(df, bench).collect())
    assert got == [(0, ()), (2, ("7",)), (2, ("7",))]
    assert decontam.decontaminate(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(df, bench.limit(0)).collect())
    clash = df.withColumns({c: F.lit("x") for c in ("_text", "spans", "items", "pattern", "block")})
    assert decontam.decontaminate(clash, bench).where("contaminated").count() == 2


def test_patterns_are_a_spark_job_in_measured_blocks(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(50)] + [(99, "w3x1 w3x2 w3x3 w3x4")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(5)
    table = decontam.patterns(bench, "item_id", "text", 4).collect()
    assert len(table) == 50 * 37
    assert {tuple(r["items"]) for r in table if bytes(r["pattern"]) == b"w3x1 w3x2 w3x3 w3x4"} == {("3", "99")}
    total = sum(len(r["pattern"]) for r in table)
    blocks = decontam._blocks(bench, "item_id", "text", 4, total // 6)
    assert len(blocks) in (6, 7)
    sizes = [sum(len(r["pattern"]) for r in spark.read.parquet(b).collect()) for b in blocks]
    assert sum(sizes) == total and max(sizes) < total // 4
