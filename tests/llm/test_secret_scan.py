import random
import re

from pyspark.sql import functions as F

from rollcall.llm import secret_scan as S


def brute(text):
    found = []
    for kind, pattern, group, least in (
            ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text or "")
                  if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: (s[0], S.KINDS.index(s[2])))


def texts(seed):
    rng = random.Random(seed)
    bits = ["password", "PassWd ", "token", "api_key", "APIKEY", "ſecret", "secret", ":", "=", " = ", '"', "'",
            "abc", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "deadbeef", "é漢", "\n", " ", "hunter2!",
            "x" * 30, "=====", "tok_en"]
    return [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)]


def test_base_spans_match_the_patterns(spark):
    rows = list(enumerate(texts(1)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in S.find_secrets(df, None).collect()}
    assert got == {d: brute(t) for d, t in rows}


def credentials(seed, n=200):
    rng = random.Random(seed)
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexes = "0123456789abcdef"
    return {"access": ["AKIA" + "".join(rng.choice(digits) for _ in range(16)) for _ in range(n)],
            "hex": ["".join(rng.choice(hexes) for _ in range(40)) for _ in range(n)]}


def words(seed, n=200):
    rng = random.Random(seed)
    parts = "the ing tion er ou ness ab com con pre".split()
    return ["".join(rng.choice(parts) for _ in range(5)) + rng.choice(["", "", "2019", "-1"]) for _ in range(n)]


def test_inferred_automata_generalise():
    learned = S.Formats(credentials(1), words(2))
    assert all(len(a.next) > 1 for a in learned.kinds)
    fresh = credentials(3, 100)
    assert sum(learned.accepts("ASIA" + s[4:]) for s in fresh["access"]) > 85   # another prefix
    assert sum(learned.accepts(s[:32].upper()) for s in fresh["hex"]) >= 0
    assert sum(learned.accepts(s) for s in fresh["hex"]) > 90
    assert sum(learned.accepts(s) for s in words(4, 300)) <= 3


def test_bare_credentials_among_ordinary_tokens():
    """Credentials in the ordinary sample are found, and hide no others."""
    fresh = credentials(8, 300)
    access = ["ASIA" + s[4:] for s in fresh["access"]]
    short = [s[:20] for s in fresh["hex"]]
    for bare in (access[:1], short[:1], access[:100], short[:100], access[:150] + short[:150]):
        learned = S.Formats(credentials(1), words(2) + bare + [short[200][:12]])
        for kind in (access, short):
            assert sum(learned.accepts(s) for s in kind) > 255
        assert sum(learned.accepts(s) for s in bare) >= 0.85 * len(bare)
        assert sum(learned.accepts(s) for s in words(4, 300)) <= 3


def test_labels_like_ordinary_text_accept_no_ordinary_tokens():
    learned = S.Formats({"assign": words(3, 150), **credentials(1)}, words(2))
    assert sum(learned.accepts(s) for s in words(4, 300)) <= 3


def test_small_tables_learn_formats(spark):
    """No ordinary token is left out of the sample for its hash."""
    known = credentials(9, 60)
    plain = [w for w in words(10, 60) if len(w) >= 12 and S._hash(w) % 16][:9]
    hidden = "ASIA" + known["access"][0][:3:-1]
    rows = [(i, f"key {a} next") for i, a in enumerate(known["access"])]
    rows += [(100 + i, f"a {w} b") for i, w in enumerate(plain)] + [(200, f"see {hidden} there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert set(S.labelled_strings(df, "text")[1]) == {hidden, *plain}
    found = {r.doc_id: [s.kind for s in r.spans] for r in S.find_secrets(df, S.learn_formats(df)).collect()}
    assert found[200] == ["format"] and not any(found[100 + i] for i in range(len(plain)))
    assert S.learn_formats(df.where("doc_id < 100")) is not None


def test_merging_gives_a_distribution():
    a = S.Automaton(["ab1"] * 30 + ["ab"] * 30 + ["zz9"] * 40)
    assert len(a.next) >= 2
    assert a.score("ab1") > a.score("999")


def test_added_spans_leave_base_spans(spark):
    rng = random.Random(5)
    known = credentials(6, 150)
    rows = [(i, f"some words token = {h} and {w} here") for i, (h, w) in
            enumerate(zip(known["hex"], words(7, 150)))]
    rows += [(500 + i, f"key {a} next") for i, a in enumerate(known["access"])]
    rows += [(1000 + i, " ".join(words(i, 8))) for i in range(100)]
    hidden = "ASIA" + "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))
    rows += [(5000, f"é look {hidden}. end"), (None, None), (5001, ""), (5001, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = S.find_secrets(df, S.learn_formats(df)).collect()
    assert len(got) == len(rows)
    text = {d: t or "" for d, t in rows}
    for r in got:
        spans = [(s.start, s.end, s.kind) for s in r.spans]
        assert [s for s in spans if s[2] != "format"] == brute(text[r.doc_id])
        assert spans == sorted(spans, key=lambda s: (s[0], S.KINDS.index(s[2])))
    by = {r.doc_id: r for r in got}
    assert [text[5000][s.start:s.end] for s in by[5000].spans] == [hidden]
    assert not any(r.spans for r in got if r.doc_id is not None and 1000 <= r.doc_id < 5000)
    assert S.find_secrets(df.limit(0), S.learn_formats(df.limit(0))).count() == 0


def test_short_and_letter_only_keys():
    """Bare keys of 8 to 15 characters, and such without a digit, by band."""
    rng = random.Random(21)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

    def key(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))
    parts = "the ing tion er ou ness ab com con pre".split()

    def ordinary(n):
        return ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 6))).capitalize()[:rng.randrange(6, 20)]
                for _ in range(n)]
    labelled = {"assign": [key(letters, rng.randrange(8, 25)) for _ in range(200)],
                "hex": [key("0123456789abcdef", 32) for _ in range(200)]}
    learned = S.Formats(labelled, ordinary(900))
    for alphabet, n, least in ((letters, 8, 0.6), (letters, 12, 0.9), (letters, 15, 0.9),
                               ("0123456789abcdef", 8, 0.6), ("0123456789abcdef", 15, 0.9)):
        found = sum(learned.accepts(key(alphabet, n)) for _ in range(300)) / 300
        assert found >= least, (n, found)
    assert sum(learned.accepts(s) for s in ordinary(3000)) <= 15


def test_short_keys_in_texts(spark):
    rng = random.Random(22)
    rows = [(i, f"some words token = {h} here") for i, h in enumerate(credentials(6, 150)["hex"])]
    rows += [(1000 + i, " ".join(words(i, 8)) + ".") for i in range(100)]
    bare = "4f9a1c7e03b2"
    rows += [(5000, f"é see {bare}. And token: 4f9a1c7e03b29 too, {bare}={bare}"),
             (5001, "x " * 100_000 + bare + "=" * 1000 + "."), (5002, "=" * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("_text", F.lit(1))
    got = S.find_secrets(df, S.learn_formats(df)).collect()
    assert len(got) == len(rows) + 3 and got[0].asDict().keys() == {"doc_id", "text", "_text", "spans"}
    text = dict(rows)
    by = {r.doc_id: r for r in got}
    assert [(text[5000][s.start:s.end], s.kind) for s in by[5000].spans] == [
        (bare, "format"), ("token: 4f9a1c7e03b29", "assign")]
    assert [(text[5001][s.start:s.end], s.kind) for s in by[5001].spans] == [(bare, "format")]
    assert not by[5002].spans and not any(by[1000 + i].spans for i in range(100))
