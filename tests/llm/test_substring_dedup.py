import random
import re
from decimal import Decimal

import pytest

from rollcall.llm import repeats, substring_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(2000)]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]
    shared = [text(n) for n in (30, 45, 60, 75, 120, 300, 900)]
    rows = []
    for i in range(90):
        parts = [text(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), text(rng.randrange(0, 40))]
        flat = [w.upper() if rng.random() < 0.1 else w for p in parts for w in p]
        rows.append("".join(w + rng.choice([" ", "\n", "  "]) for w in flat))
    rows += [rows[0], rows[1], None, "", " ".join(text(20)) + " " + " ".join(shared[2][:49])]
    return list(enumerate(rows))


def repeated_docs(rows, size=50):
    seen = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i:i + size]), set()).add(d)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_finds_repeated_passages_and_nothing_else(spark, seed):
    rows = corpus(seed)
    seen = repeated_docs(rows)
    want = {d for docs in seen.values() if len(docs) > 1 for d in docs}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substring_dedup.repeated_passages(df).collect()
    got = {r.doc_id for r in out}
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    text = dict(rows)
    for r in out:
        w = words(text[r.doc_id][r.start:r.end])
        assert len(w) == r.n_words >= 50
        assert all(len(seen[tuple(w[i:i + 50])]) > 1 for i in (0, len(w) - 50))
        assert r.first_id in seen[tuple(w[:50])] and r.keep == (r.first_id == r.doc_id)


def brute_passages(rows, size=50):
    """(id, first word, end word, first id) of every repeated passage."""
    seen = repeated_docs(rows, size)
    out = set()
    for d, t in rows:
        w = words(t)
        now = None
        for i in range(len(w) - size + 1):
            docs = seen[tuple(w[i:i + size])]
            if len(docs) < 2:
                continue
            if now and i < now[1] and now[2] == min(docs):
                now[1] = i + size
                continue
            if now:
                out.add((d, *now))
            now = [i, i + size, min(docs)]
        if now:
            out.add((d, *now))
    return out


def passages(df):
    text = dict((r.doc_id, r.text) for r in df.collect())
    out = set()
    for r in substring_dedup.repeated_passages(df).collect():
        before = len(words(text[r.doc_id][:r.start]))
        out.add((r.doc_id, before, before + r.n_words, r.first_id))
    return out


def test_quotes_from_the_middle_of_copied_text(spark):
    """Short quotes of a text that has a copy itself, extents included."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]
    rows = []
    for k in range(12):
        base = text(600)
        edited = base[:290] + text(1) + base[291:]
        rows += [base, base if k % 2 else edited]
        for _ in range(6):
            size, at = rng.randrange(51, 61), rng.randrange(50, 490)
            rows.append(text(rng.randrange(0, 90)) + base[at:at + size] + text(rng.randrange(0, 90)))
        rows.append(text(40) + base[100:260] + text(30) + base[300:480])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == brute_passages(rows)


def test_neighbours_of_other_owners_stay(spark):
    """Documents X, X then Y, and Y: the second keeps Y, so Y is not lost."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    df = spark.createDataFrame([(1, x), (2, x + " " + y), (3, y)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_words, r.first_id, r.keep)
                 for r in substring_dedup.repeated_passages(df).collect())
    assert got == [(1, 0, 60, 1, True), (2, 0, 60, 1, False), (2, len(x) + 1, 60, 2, True), (3, 0, 60, 2, False)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dropping_leaves_every_repeated_window_whole_in_its_owner(spark, seed):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(40):                     # overlapping quotes of one text, in any order
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(0, 320)
            parts += base[a:a + rng.randrange(51, 80)] + [f"u{i}"] * rng.randrange(0, 2)
        rows.append((i, " ".join(parts)))
    found = substring_dedup.repeated_passages(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    text = dict(rows)
    left = {}
    for d, t in rows:
        cut = [(r.drop_start, r.drop_end) for r in found if r.doc_id == d and r.drop_start is not None]
        left[d] = " ".join(words("".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in cut))))
    reported = {tuple(w) for r in found for w in
                [words(text[r.doc_id][r.start:r.end])[k:k + 50] for k in range(r.n_words - 49)]}
    for window, docs in repeated_docs(rows).items():
        if len(docs) < 2 or window not in reported:
            continue
        keeping = {r.doc_id for r in found if r.keep and f" {' '.join(window)} " in
                   f" {' '.join(words(text[r.doc_id][r.start:r.end]))} "}
        assert keeping == {min(docs)}
        assert f" {' '.join(window)} " in f" {left[min(docs)]} "
    assert sum(map(len, left.values())) < sum(map(len, text.values())) / 2


def test_batches_of_several_slices(spark):
    """Texts that fill many slices of one Arrow batch keep their own hashes."""
    rng = random.Random(8)
    shared = [[f"s{k}w{rng.randrange(9999)}" for _ in range(90)] for k in range(40)]
    rows = []
    for i in range(160):
        w = [f"u{i}x{rng.randrange(99999)}" for _ in range(3000)]
        rows.append((i, " ".join(w[:1500] + (shared[i % 80 // 2] if i % 2 else []) + w[1500:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {i for i, _ in rows if i % 2}


def test_insertion_moves_no_far_boundary():
    import numpy as np
    rng = random.Random(4)
    a = [f"w{rng.randrange(5000)}" for _ in range(600)]
    b = a[:200] + ["new"] + a[200:]

    def ends(t):
        raw = np.frombuffer(" ".join(t).encode(), np.uint8)
        return {int(x) for x in substring_dedup.Chunks(raw, np.array([0, len(raw)])).bound}
    one, two = ends(a), ends(b)
    assert {x for x in one if x < 200} == {x for x in two if x < 200}
    assert {x + 1 for x in one if x > 210} == {x for x in two if x > 211}


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(80))
    same = "again " * 400
    rows = [(None, long, 1), (3, "a b " + long, 2), (4, same + "end", 3), (4, same + "end", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep int")
    out = substring_dedup.repeated_passages(df).collect()
    assert sorted((str(r.doc_id), r.first_id) for r in out) == [("3", 3), ("None", 3)]
    assert all(70 <= r.n_words <= 80 for r in out)
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_repeated_hashes(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(repeats, "HELD", 40)
    rng = random.Random(6)
    rows = [(k, {rng.randrange(1, 400) << 55 for _ in range(rng.randrange(0, 30))} | {77})
            for k in range(-60, 60)]
    data = [(k, [Decimal(x) for x in sorted(h)]) for k, h in rows] * 2
    df = spark.createDataFrame(data, "key long, hashes array<decimal(20,0)>").repartition(5)

    def hashes_of(b):
        for key, hs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield key, np.array([int(h) for h in hs], dtype=np.uint64)
    count = {}
    for _, hs in rows:
        for h in hs:
            count[h] = count.get(h, 0) + 1
    got: dict[int, set] = {}
    for r in repeats.repeated_hashes(df, 7, hashes_of).collect():
        found = np.frombuffer(bytes(r.hashes), np.uint64).tolist()
        assert r.n_found == len(found) and r.n_low == sum(h < 1 << 62 for h in found)
        got.setdefault(r.key, set()).update(found)
    assert got == {k: {h for h in hs if count[h] > 1} for k, hs in rows}


def test_windows_are_not_written_one_by_one(spark, monkeypatch):
    """Long copies: tables of a row per window cost several times the input."""
    rows = [(i, " ".join(f"g{i // 4}w{k}" for k in range(900))) for i in range(40)]
    n_rows = {}
    kept = substring_dedup.written

    def counted(df, name):
        out = kept(df, name)
        n_rows[name] = out.count()
        return out
    monkeypatch.setattr(substring_dedup, "written", counted)
    got = passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == {(i, 0, 900, i // 4 * 4) for i in range(40)}
    assert n_rows and sum(n_rows.values()) < 40 * 850 / 5


def test_stretches_of_many_senders(spark, monkeypatch):
    """Few windows held, short stretches, one hot passage, very long words, ids
    that are text or null: as by brute force."""
    monkeypatch.setattr(substring_dedup, "HELD", 100)
    monkeypatch.setattr(substring_dedup, "MAX_STRETCH", 7)
    rng = random.Random(3)
    shared = [[f"s{k}w{i}" + "x" * (300 if i == 30 else 0) for i in range(90)] for k in range(3)]
    rows = []
    for i in range(60):
        own = [f"u{i}x{k}" for k in range(rng.randrange(0, 60))]
        a = rng.randrange(0, 30)
        rows.append((f"é{i * 7 % 61}" if i % 2 else f"d{i}", " ".join(own + shared[0] + own + shared[1 + i % 2][a:a + 55])))
    rows.append(("a", "again " * 300 + "end"))
    rows.append(("b", "Again  " * 200 + "end"))
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    assert passages(df) == brute_passages(rows)
    alone = " ".join(f"n{i}" for i in range(70))
    nulls = spark.createDataFrame([(None, alone), (None, alone + " more")], "doc_id string, text string")
    assert [(r.doc_id, r.first_id, r.n_words) for r in substring_dedup.repeated_passages(nulls).collect()] \
        == [(None, None, 70)] * 2
