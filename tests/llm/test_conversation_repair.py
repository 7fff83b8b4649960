"""Conversation repair against the plain way: every audit of a sequence, each
with its cost, and conversations walked row by row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rollcall.llm import conversation_repair, queries
from rollcall.llm import turn_grammar as G

SCHEMA = "conv_id long, turn long, role string, text string"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows, most_inserts=2):
    """(cost, audit, repaired roles) over all audits of (role, truncated, must go) rows."""
    ways = {("", 0, "", ())}                       # state, cost, audit, (role, row) that stay

    def inserted(ways):
        out = set(ways)
        for _ in range(most_inserts):
            ways = {(AFTER[s, r], c + 2, a + "I", k + ((r, None),))
                    for s, c, a, k in ways for r in "ua" if (s, r) in AFTER}
            out |= ways
        return out

    def least(ways):                               # of equal state, cost and audit one is enough
        best = {}
        for w in sorted(ways):
            if (w[0], w[2]) not in best:
                best[w[0], w[2]] = w
        ways = best.values()
        low = {s: min(w[1] for w in ways if w[0] == s) for s in {w[0] for w in ways}}
        return {w for w in ways if w[1] <= low[w[0]]}

    for n, (role, truncated, must_go) in enumerate(rows):
        out = set()
        for s, c, a, k in inserted(ways):
            out.add((s, c + 3, a + "D", k))
            if not must_go:
                if (s, role[:1]) in AFTER:
                    out.add((AFTER[s, role[:1]], c + truncated, a + "K", k + ((role, n),)))
                for r in "ua":
                    if (s, r) in AFTER:
                        out.add((AFTER[s, r], c + 2 + truncated, a + "R", k + ((r, n),)))
        ways = least(out)
    return min((c, a, k) for s, c, a, k in inserted(ways) if s in ("", "a"))


def plain(rows, ids):
    """The contract's row of each conversation."""
    convs = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text))
    out = []
    for conv, rs in convs.items():
        rs.sort()
        seen, faults, dp = set(), [0, 0, 0], []
        for _, _, role, _, text in rs:
            end = text.strip(WHITE)[-1:]
            fault = (0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None)
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            dp.append((role, fault == 2, fault in (0, 1)))
        turns = [t for known, t, *_ in rs if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit, kept = cheapest(dp)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[r]}:" if n is None else f"{r if audit and r == rs[n][2] else names.get(r, r)}:{rs[n][4]}"
                 for r, n in kept]
        out.append((conv, gaps, *faults, illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, ids=None, digests=True):
    report = conversation_repair.repair_report(df, ids)
    out = conversation_repair.repaired_digests(df, report)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_rows(rng, convs, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "what", "  ", "", None, "a. ", "b?\n", "a."]
    return [(c, rng.choice([t, t, t, None, 3]), rng.choice(roles), rng.choice(texts))
            for c in range(convs) for t in range(rng.randrange(longest))]


def test_sequences_against_all_audits(monkeypatch):
    monkeypatch.setattr(G, "MIN_USES", 2)
    monkeypatch.setattr(G, "FOLD", 2)
    rng = random.Random(3)
    rows = [[(rng.choice(["s", "u", "a", "a", "x"]), rng.random() < 0.3, rng.random() < 0.2)
             for _ in range(rng.randrange(7))] for _ in range(300)]
    grammar_of = [bytes(G.MUST_GO if m else G.symbol(r, t) for r, t, m in rs) for rs in rows]
    grammar = G.Grammar(grammar_of)
    assert len(grammar.matrix) > len(G.BASE) + 10           # rules are at work
    for rs, sequence in zip(rows, grammar_of):
        assert G.finished(grammar.from_start(sequence)) == cheapest(rs)[:2]


def test_grammar_gives_back_its_sequences(monkeypatch):
    monkeypatch.setattr(G, "MIN_USES", 2)
    rng = random.Random(4)
    sequences = [bytes(rng.choice([2, 4, 2, 4, 8]) for _ in range(rng.randrange(40))) for _ in range(50)]
    sequences += [bytes([2] * 33), b"", bytes([2, 4] * 40)]
    rules, over = G.re_pair(sequences)

    def spelled(s):
        return [s] if s < len(G.BASE) else spelled(rules[s - 9][0]) + spelled(rules[s - 9][1])

    assert [bytes(x for s in o for x in spelled(s)) for o in over] == sequences
    assert sum(map(len, over)) + 2 * len(rules) < sum(map(len, sequences)) / 2


def test_ropes_compare_as_texts():
    rng = random.Random(5)
    ropes = [G.Rope("")]
    for _ in range(300):
        a, b = rng.choice(ropes), rng.choice(ropes)
        ropes.append(a + b + G.Rope("".join(rng.choice("DK") for _ in range(rng.choice([0, 1, 9, 40])))))
        if ropes[-1].size > 5000:
            ropes.pop()
    for _ in range(2000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b))


def test_conversations_against_plain(spark):
    rows = some_rows(random.Random(6), 150, 7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(df) == plain(rows, [])


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_a_hot_conversation_in_many_pieces(spark, monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", f"{t}.", f"{t}"])) for t in range(60)]
    rows += [(2, 5, "user", "same.")] * 40 + [(c, 0, "user", "hi.") for c in range(3, 30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = conversation_repair._pieces(conversation_repair._narrow(conversation_repair._source(df)))
        assert pieces.where("conv_id = 1").count() > 2
        assert found(df) == plain(rows, [])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows_are_what_the_digest_says(spark):
    rows = some_rows(random.Random(8), 60, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    report = conversation_repair.repair_report(df)
    texts = {}
    for r in sorted(conversation_repair.repaired_rows(df, report).collect(), key=lambda r: (r.conv_id, r.place)):
        texts.setdefault(r.conv_id, []).append(r)
    for r in conversation_repair.repaired_digests(df, report).collect():
        own = texts.get(r.conv_id, [])
        assert [o.place for o in own] == list(range(len(own)))
        assert "".join(o.edit for o in own) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{o.role}:{o.text}" for o in own).encode()).hexdigest() == r.repaired_sha256
        initials = "".join(o.role[:1] for o in own)
        assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"


def test_damage(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"t{c}. What? {t}!") for c in range(40) for t in range(6)]
    rows += [(None, None, None, None), (90, None, "user", None)]
    got = sorted(tuple(r) for r in queries.damaged(spark.createDataFrame(rows, SCHEMA)).fillna(-1).collect())
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        row = (-1 if c is None else c, -1 if t is None else t, "user" if h == 4 else role, text)
        want += [] if h == 0 else [row] * (2 if h == 3 else 1)
    assert got == sorted(want)


def test_query_on_the_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in queries.damaged(source).select("conv_id", "turn", "role", "text").collect()]
    ids = {r.conv_id for r in source.collect()}
    out = queries.queries()["op12_conversation_repair"](spark, sf_dir)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows, ids)


def test_edges(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 0, "user", "word " * 100_000 + "end."),
            (1, 0, "user", "word " * 100_000 + "end."), (1, 9, "assistant", "x."), (2, None, "user", "a."),
            (2, None, "user", "a."), (2, 4, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = spark.createDataFrame([(1,), (7,), (7,), (None,)], "conv_id long")
    want = plain(rows, [7])
    assert found(df, ids) == want
    clash = df.withColumns({c: F.lit("x") for c in ("digest", "blank", "n", "first", "place", "audit", "_report", "_row")})
    assert found(clash, ids) == want
    assert next(r for r in want if r[0] == 7)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and conversation_repair.repaired_rows(
        empty, conversation_repair.repair_report(empty)).collect() == []
