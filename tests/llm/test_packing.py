import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rollcall.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(lengths, seq_len):
    hist = Counter(lengths)
    runs, n = packing.plan_packing(hist, seq_len)
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, first, count, seq, offset in runs.tolist():
        ranks[length].append((first, count))
        for k in range(count):
            fill[seq + k].append((offset, length))
    for length, parts in ranks.items():       # every piece exactly once
        at = 0
        for first, count in sorted(parts):
            assert first == at
            at += count
        assert at == hist[length]
    assert sum(map(len, fill.values())) == len(lengths) and sorted(fill) == list(range(n))
    for parts in fill.values():               # gapless, and none too long
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    return n


def first_fit_decreasing(lengths, seq_len):
    rooms = []
    for x in sorted(lengths, reverse=True):
        for i, room in enumerate(rooms):
            if room >= x:
                rooms[i] -= x
                break
        else:
            rooms.append(seq_len - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_sound_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 101, 300), np.minimum(rng.lognormal(3, 1, 400).astype(int) + 1, 100),
               rng.integers(30, 60, 200), np.full(50, 34)][seed % 4].tolist()
    n = check_plan(lengths, 100)
    assert n <= 1.02 * first_fit_decreasing(lengths, 100) + 1


def test_small_plans():
    assert check_plan([], 10) == 0
    assert check_plan([10], 10) == 1
    assert check_plan([1] * 25, 10) == 3
    assert check_plan([6, 6, 4, 4], 10) == 2


def test_configurations_serve_every_size():
    found = packing.configurations([60, 40, 30], [100, 100, 50], 100)
    served = sum(c * x for c, x in found)
    assert np.allclose(served, [100, 100, 50])
    assert all(c @ [60, 40, 30] <= 100 for c, _ in found)


def test_round_trip(spark):
    rng = random.Random(3)
    vocab = ["The", "quick.", "brown", "Über", "fox", "<|endoftext|>", "a,b", "漢字", "don't"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 300)))) for i in range(60)]
    docs += [(900, None), (901, ""), (902, "word " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    packed = packing.pack_documents(df, PATH, seq_len=256, keep_ids=True)
    rows = packed.collect()
    tok = Tokenizer.from_file(PATH)
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32))
    assert set(parts) == {d for d, _ in docs}
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        got, at = b"", 0
        for k, (piece, start, length, blob, crc) in enumerate(sorted(parts[d])):
            assert (piece, start) == (k, at) and crc == zlib.crc32(blob) and 0 < length <= 256
            got, at = got + blob, at + length
        assert got == np.array(ids, "<u4").tobytes()
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for seq in packing.sequences(packed).collect():
        held = sorted(fill[seq.sequence_id])
        assert bytes(seq.ids) == b"".join(x[2] for x in held) and seq.length <= 256
        assert [x[0] for x in held] == np.cumsum([0] + [x[1] for x in held])[:-1].tolist()


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 2), (None, None, 3)], "doc_id long, text string, piece int")
    rows = packing.pack_documents(df, PATH).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 2), ("1", 2), ("None", 1)]
    assert sorted(r.offset for r in rows) in ([0, 1, 3], [0, 2, 3], [0, 2, 4])
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
