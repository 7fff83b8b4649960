import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rollcall.llm import encode, token_files
from rollcall.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(8)
    vocab = ["The", "quick.", "BROWN,", "Über", "fox!.", "<|endoftext|>", "<|ENDOFTEXT|>.", "a,b",
             "漢字。", "don't.", "é", "́x", "\x1cq", " ", " z", "it's,", "ΑΣ.", "q..,"]
    gaps = [" ", "\n", "  ", "\t", " ", ""]
    return [None, "", " "] + ["".join(rng.choice(vocab) + rng.choice(gaps)
                                      for _ in range(rng.randrange(0, 200))) for _ in range(120)]


def test_encoder_equals_the_library(monkeypatch):
    for path in (PATH, MULTI):
        tok = Tokenizer.from_file(path)
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts()]
        for memory in (encode.MEMORY, 50):
            monkeypatch.setattr(encode, "MEMORY", memory)
            monkeypatch.setattr(encode, "GROUP_BYTES", 500)
            enc = encode.Encoder(path)
            for _ in range(2):
                assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts())] == want
    assert encode.Encoder(PATH).word_wise and not encode.Encoder(MULTI).word_wise


def test_exact_round_trip(spark):
    docs = list(enumerate(texts()))
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(df, path, PATH, end_id=1)
    rows = token_files.read_token_files(spark, path).collect()
    tok = Tokenizer.from_file(PATH)
    at, by_id = 0, {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for d, t in sorted(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        r = by_id[d]
        assert (r.start, r.n_tokens) == (at, len(ids))
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    manifest = token_files.read_manifest(spark, path).orderBy("part").collect()
    assert [m.first_id for m in manifest] == np.cumsum([0] + [m.n_ids for m in manifest])[:-1].tolist()
    first = token_files.TokenPart(path, manifest[0]["name"])
    assert first.flat.dtype == np.dtype("<u2") and len(first) == manifest[0].n_docs


def test_edges(spark):
    df = spark.createDataFrame([("b", "x", 1), (None, "y", 2), ("b", "x", 1)],
                               "doc_id string, text string, start int")
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(df, path, PATH, end_id=None)
    got = token_files.read_token_files(spark, path, "string").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 1), ("b", 1, 1), ("b", 2, 1)]
    path = scratch_path(spark, "test-token-files")
    token_files.write_token_files(df.limit(0), path, PATH)
    assert token_files.read_token_files(spark, path, "string").count() == 0
