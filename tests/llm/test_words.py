import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import words as W

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_text(rng, n):
    return "".join(rng.choice("aAbÉß漢 \t\n\r\x0b\x0c\x1c\x85 ,.") for _ in range(rng.randrange(n)))


@pytest.mark.parametrize("slice_bytes", [1, 40, 1 << 20])
def test_words_are_those_of_the_pattern(slice_bytes):
    rng = random.Random(slice_bytes)
    texts = [None, "", " ", "a", "b "] + [random_text(rng, 60) for _ in range(200)]
    got = [[] for _ in texts]
    for row, data, offsets in W.string_slices(pa.array(texts), slice_bytes):
        w = W.Words(data, offsets, fold=True)
        for r, s, e in zip(w.row, w.start, w.end):
            got[row + r].append(w.data[s:e].tobytes().decode())
    assert got == [SPACE.findall((t or "").translate(FOLD)) for t in texts]


def test_hashes_depend_on_the_word_only():
    rng = random.Random(5)
    texts = [random_text(rng, 400) for _ in range(300)] + ["x" * 5000 + " y " + "x" * 5000, "x" * 5001]
    seen = {}
    for _, data, offsets in W.string_slices(pa.array(texts), 700):
        w = W.Words(data, offsets)
        for h, s, e in zip(w.hashes().tolist(), w.start, w.end):
            seen.setdefault(data[s:e].tobytes(), set()).add(h)
    assert all(len(v) == 1 for v in seen.values())
    assert len({min(v) for v in seen.values()}) == len(seen)


def test_ngrams_do_not_cross_texts():
    texts = pa.array(["a b c", "a b", None, "c a b c"])
    (_, data, offsets), = W.string_slices(texts)
    w = W.Words(data, offsets)
    at, grams = w.ngrams(w.hashes(), 3)
    assert w.row[at].tolist() == [0, 3, 3]
    assert grams[0] == grams[2] != grams[1]


def test_sliced_arrow_array():
    texts = pa.array(["zero", "one two", None, "three"])[1:]
    (_, data, offsets), = W.string_slices(texts)
    assert W.Words(data, offsets).per_row().tolist() == [2, 0, 1]
    assert list(W.string_slices(pa.array([], pa.string()))) == []
    assert np.array_equal(W.mix(np.array([7], np.uint64)), W.mix(np.array([7], np.uint64)))
