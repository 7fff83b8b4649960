import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollcall.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    hits = set()
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hits |= {i + j for i in at for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hits)]


def texts_of(seed, n=300):
    rng = random.Random(seed)
    out = [None, "", "\n\n", "a", "é é é é\né é é é", "a\na\n a\n\na"]
    for _ in range(n):
        words = [rng.choice("a b c dd É 漢字 # <x> %%% e| f".split()) for _ in range(rng.randrange(80))]
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t", " ", "\x1c"]) for x in words))
    return out


def test_counts_match_brute_force():
    texts = texts_of(1)
    got = quality.text_counts(pa.array(texts))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [[int(got[c][i]) for c in names] for i in range(len(texts))] == [brute(t) for t in texts]


def test_em_finds_the_bad_class():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    acc = [0.9, 0.8, 0.7, 0.85]
    votes = np.stack([np.where(good, rng.choice([0, 1], 4000), np.where(rng.random(4000) < a, 2, 0))
                      for a in acc], 1)
    pat, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, probs = quality.fit_votes(pat, n.astype(float))
    post = quality.posterior(pat, share, probs)[inv.ravel()]
    assert ((post >= 0.5) == good).mean() > 0.95
    assert abs(share - 0.8) < 0.1


def planted(n, seed):
    """Votes of rules with known accuracies, as a histogram; and the probabilities
    (vote bad in a good document, vote bad in a bad one)."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.75
    known = [(0.40, 0.45), (0.02, 0.90), (0.05, 0.70), (0.10, 0.60)]     # the first knows nothing
    bad = np.stack([np.where(good, rng.random(n) < a, rng.random(n) < b) for a, b in known], 1)
    sure = rng.random(bad.shape) < 0.5                                  # else it abstains
    votes = np.where(bad, 2, np.where(sure, 1, 0))
    pat, inv, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return good, pat, inv.ravel(), count, known


def test_planted_accuracies_are_estimated_at_any_size():
    for n in (10_000, 1_000_000):
        good, pat, inv, count, known = planted(n, n)
        share, probs = quality.fit_votes(pat, count.astype(float), rounds=2000)
        assert abs(share - 0.75) < 0.05
        for rule, (in_good, in_bad) in enumerate(known):
            assert abs(probs[1, rule, 2] - in_good) < 0.05
            assert abs(probs[0, rule, 2] - in_bad) < 0.05
        kept = (quality.posterior(pat, share, probs) >= 0.5)[inv]
        must_pass = ~(pat == 2).any(1)[inv]
        assert (kept == good).mean() > 0.9 > (must_pass == good).mean() + 0.2


def plain_em(votes, rounds):
    """The model by documents instead of patterns, with plain sums."""
    post = [0.1 if 2 in v else 0.95 for v in votes]
    prior = [[0.2, 0.4, 0.4], [0.2, 0.79, 0.01]]
    for _ in range(rounds):
        weight = [[1 - p for p in post], post]
        share = (sum(post) + 1) / (len(votes) + 2)
        probs = []
        for c in (0, 1):
            rules = []
            for r in range(len(votes[0])):
                n = [20 * prior[c][x] + sum(w for w, v in zip(weight[c], votes) if v[r] == x) for x in range(3)]
                rules.append([x / sum(n) for x in n])
            probs.append(rules)
        post = []
        for v in votes:
            like = [1 - share, share]
            for c in (0, 1):
                for r, x in enumerate(v):
                    like[c] *= probs[c][r][x]
            post.append(like[1] / sum(like))
    return post


def test_kept_matches_plain_em(spark):
    """Over whole documents: the verdict is the posterior's, not all-must-pass."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(240):
        words = [rng.choice(vocab) for _ in range(rng.randrange(55, 160))]
        if i % 6 == 0:
            words = [w + " %%%" for w in words]
        ends = rng.choice([".", ".", ".", ""])
        rows.append((i, (ends + "\n").join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9)) + ends))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in quality.score_quality(docs, keep_text=False).collect()}
    rules = quality.votes()
    voted = quality.with_counts(docs).select("doc_id", *[v.alias(n) for n, v in rules.items()]).collect()
    votes = [[r[n] for n in rules] for r in voted]
    for r, p in zip(voted, plain_em(votes, quality.EM_ROUNDS)):
        assert abs(got[r.doc_id].p_good - p) < 1e-6
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and p >= 0.5)
    differs = [r.doc_id for r, v in zip(voted, votes) if got[r.doc_id].kept and 2 in v]
    assert len(differs) > 20                   # kept in spite of a bad vote
    assert not any(got[i].kept for i in range(0, 240, 6))


def test_scores_labels_and_edges(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.score_quality(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.p_good <= 1
    told = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(k == bool(q) for q, k in told) / len(told) > 0.95

    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)],
                                "doc_id long, text string, kept int")
    got = quality.score_quality(odd).collect()
    assert len(got) == 3 and not any(r.kept for r in got)
    assert quality.score_quality(odd.limit(0)).count() == 0
    clash = odd.withColumns({c: F.lit("x") for c in ("n_words", "p_good", "base_failed", "v0", "_text")})
    assert len(quality.score_quality(clash).collect()) == 3
    long = spark.createDataFrame([(1, "some words here. " * 300_000)], "doc_id long, text string")
    assert quality.score_quality(long).first().n_words == 900_000
