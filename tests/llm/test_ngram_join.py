import random
import re

import numpy as np
import pytest

from rollcall.llm import components, ngram_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(n, links):
    at = list(range(n))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def brute(rows, k, num, den):
    rows = sorted(rows)
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    top = groups(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[top[i]][0]) for i in range(len(rows))}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    common = " ".join(f"c{i}" for i in range(30))
    rows = []
    for family in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 9, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            text = rng.choice([" ", "\n", " \t"]).join(w)
            rows.append(text + (" " + common if rng.random() < 0.3 else ""))
    rows += [None, "", " \n", "one", "ONE", "one two", "x " * 500, "x " * 300]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,k,num,den,block", [(1, 4, 85, 100, 4000), (2, 5, 4, 5, 3),
                                                  (3, 4, 85, 100, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, k, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)   # 2, 3: clusters in pairs of blocks
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = ngram_join.jaccard_components(df, words=k, num=num, den=den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, k, num, den)
    assert sorted(r.doc_id for r in out if r.keep) == sorted({c for _, c in brute(rows, k, num, den).values()})


def test_edges(spark):
    text = "a b c d e f"
    rows = [(None, text, 1), (5, text, 2), (5, text, 2), (7, text + " g h i j k l", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    out = ngram_join.jaccard_components(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == [
        ("5", 3, "5"), ("5", 3, "5"), ("7", 9, "7"), ("None", 0, "None"), ("None", 3, "5")]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_keeps_one_of_repeated_rows(spark):
    rows = [(5, "a b c d e f")] * 6 + [(8, "a b c d e f")] * 2 + [(None, None)] * 3 + [(9, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = ngram_join.jaccard_components(df).collect()
    assert len(out) == len(rows)
    assert sorted(str(r.doc_id) for r in out if r.keep) == ["5", "9", "None"]


def trial(rng):
    base = [[rng.randrange(60) for _ in range(rng.randrange(5, 40))] for _ in range(4)]
    sets = []
    for _ in range(rng.randrange(2, 25)):
        s = set(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            if len(s) > 1:
                s.discard(rng.choice(sorted(s)))
        sets.append(frozenset(s | {rng.randrange(200) for _ in range(rng.randrange(0, 4))}))
    return list(dict.fromkeys(sets))


def test_trie_finds_the_groups():
    rng = random.Random(3)
    for _ in range(150):
        sets = trial(rng)
        n, (num, den) = len(sets), rng.choice([(85, 100), (4, 5), (6, 10)])
        df = {}
        for s in sets:
            for t in s:
                df[t] = df.get(t, 0) + 1
        tokens, freqs, heads = [], [], []
        for s in sets:
            shared = sorted((df[t], t) for t in s if df[t] > 1)
            p = len(s) - -(-len(s) * num // den) + 1 - (len(s) - len(shared))
            tokens.append(np.array([t for _, t in shared], dtype=np.int64))
            freqs.append(np.array([f for f, _ in shared], dtype=np.int64))
            heads.append(max(0, min(p, len(shared))))
        sizes = np.array([len(s) for s in sets])
        true = [(i, j) for i in range(n) for j in range(i)
                if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
        for side in (None, np.array([rng.randrange(2) for _ in range(n)])):
            want = [x for x in true if side is None or side[x[0]] != side[x[1]]]
            got = ngram_join.trie_links(np.arange(n), sizes, np.array(heads), tokens, freqs, num, den, side)
            assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in want}
            assert groups(n, got) == groups(n, want)


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)] + [(7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = groups(400, links)
    assert {r.node: r.component for r in got} == {
        x: want[x] for x in {y for a, b in links if a != b for y in (a, b)}}
