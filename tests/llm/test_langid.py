import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import langid
from rollcall.llm.words import string_slices


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    crf = langid.Crf(["a", "b", "c"], np.zeros(0, np.uint64))
    crf.moves = rng.normal(size=(3, 3))
    em = rng.normal(size=(9, 3))
    start, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    post, pairs = crf.marginals(em, start, length)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for s, n in zip(start, length):
        total, p, q = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(em[s + i, y] for i, y in enumerate(path))
                         + sum(crf.moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                p[i, y] += w
            for a, b in zip(path, path[1:]):
                q[a, b] += w
        want[s:s + n] = p / total
        want_pairs += q / total
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs)


def test_features_are_those_of_the_word():
    texts = pa.array(["Der Hund", "xx der, hund!", "naïve der"])
    (_, data, offsets), = string_slices(texts)
    f = langid.Features(data, offsets)
    words = [f.words.data[s:e].tobytes().decode() for s, e in zip(f.words.start, f.words.end)]
    assert words == ["der", "hund", "xx", "der", "hund", "naïve", "der"]
    of = {}
    for i, w in enumerate(words):
        mine = tuple(tuple(x[f.of == i]) for x in f.byte) + tuple(x[i] for x in f.word)
        assert of.setdefault(w, mine) == mine
    assert max(x.max() for x in [*f.byte, *f.word]) < langid.Features.SIZE


def rows():
    en = "the cat and the dog are in the house with all of their friends today"
    de = "der hund und die katze sind mit allen ihren freunden heute in dem haus"
    import random
    rng = random.Random(2)
    out = []
    for i in range(60):
        lang, base = rng.choice([("en", en), ("de", de)])
        w = base.split()
        rng.shuffle(w)
        out.append((i, " ".join(w), lang))
    return out, en, de


def test_code_switch_and_edges(spark):
    train, en, de = rows()
    model = langid.train([(t, lang) for _, t, lang in train])
    odd = [(1, en + ".\n" + de + ".", 7), (2, None, 7), (None, "", 7), (4, "12 ... !", 7), (5, "x", 7),
           (6, "der hund " * 3000, 7), (6, "der hund " * 3000, 7)]
    df = spark.createDataFrame(odd, "doc_id long, text string, score int")
    got = langid.identify(df, model, spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7
    text = odd[0][1]
    assert [(text[s.start:s.end], s.lang) for s in by[1].spans] == [(en, "en"), (de, "de")]
    for d in (2, None, 4):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert by[5].lang_pred in ("en", "de") and by[6].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.identify(df, langid.train([])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.identify(df.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def predicted(spark):
    from rollcall.llm.queries import op6_langid
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    return op6_langid(spark, d).collect(), lang


def test_held_out_accuracy(predicted):
    got, lang = predicted
    import zlib
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    told = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id]]
    assert sum(told) / len(told) > 0.98


def test_sample_is_bounded_and_counts_copies_once(spark):
    rows = [("same text", "en")] * 300 + [(f"text number {i}", "en") for i in range(700)] + [
        (f"texte {i}", "fr") for i in range(5)] + [(None, "fr"), ("no label", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = langid.training_rows(df, "text", "lang", max_texts=100)
    assert len(got) <= 200 and len(set(got)) == len(got)
    assert sum(lang == "fr" for _, lang in got) == 5
