"""Language identification with a linear-chain conditional random field.

Words (runs of letters, A-Z in lower case) of a line form a chain, cut after
``CHAIN`` words; the labels are the languages. A word's score for a language
is the sum of learned weights of its features: prefixes and suffixes of two
and three bytes, bigrams and trigrams of its bytes with word edges, and its
entry in a lexicon of the training words. Learned transition weights tie
neighbouring words, so a short word takes the language around it. Forward-
backward gives each word's probabilities; code-switched text gets a label per
word. A text's language is the one with the largest sum over its words, and
its score that sum divided by the number of words.

The model is fitted on a sample of labelled rows, at most about ``TRAIN_TEXTS``
texts spread over the languages (chosen by a hash of the text, copies counted
once, whole texts). The driver holds the sample and the weights (about 3 MB a
language); everything else is one pass over the documents, with the weights
broadcast. All texts are scored whole.

Null texts and texts without a letter get ``und`` and score 0, and so do all
texts when there is no labelled row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, fresh, schema_with
from rollcall.llm.words import Words, code_points, string_slices

UNKNOWN = "und"
#: bound of the training sample, in texts over all languages (the sample is
#: drawn by hash, so it varies a little around it; never over twice)
TRAIN_TEXTS = 480
#: words of a chain; longer lines go on in a new chain
CHAIN = 256
ROUNDS = 24
TRI_BITS, AFFIX_BITS, LEX_BITS = 17, 15, 16

_LETTER = re.compile(r"[^\W\d_]")
_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[0x41:0x5B] = False
_NOT_WORD[0x61:0x7B] = False
_NOT_WORD[0x80:] = False


class Features:
    """Feature indexes of the words of one slice of texts.

    ``byte`` features belong to every byte of a word (``of`` names the word),
    ``word`` features to the word. Each is an index into one weight table."""

    SIZE = (1 << 16) + (1 << TRI_BITS) + 4 * (1 << AFFIX_BITS) + (1 << LEX_BITS) + 1

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets, fold=True, separators=_NOT_WORD)
        d = w.data.astype(np.int64)
        length = w.end - w.start
        n = int(length.sum())
        self.first = np.cumsum(length) - length            # of a word's bytes
        self.of = np.repeat(np.arange(len(w)), length)
        at = np.arange(n) - np.repeat(self.first - w.start, length)
        cur = d[at]
        nxt = np.where(at + 1 < w.end[self.of], d[np.minimum(at + 1, len(d) - 1)], 0)
        prv = np.where(at > w.start[self.of], d[np.maximum(at - 1, 0)], 0)
        bi = cur << 8 | nxt
        tri = (1 << 16) + _fold((prv << 16) | bi, TRI_BITS)
        self.byte = [bi, tri]
        base = (1 << 16) + (1 << TRI_BITS)
        self.word = []
        for k, (size, front) in enumerate(((2, True), (3, True), (2, False), (3, False))):
            code = np.zeros(len(w), dtype=np.int64)
            for j in range(size):
                p = w.start + j if front else w.end - 1 - j
                inside = (p < w.end) & (p >= w.start)
                code = code << 8 | np.where(inside, d[np.clip(p, 0, max(len(d) - 1, 0))], 0)
            self.word.append(base + k * (1 << AFFIX_BITS) + _fold(code, AFFIX_BITS))
        self.hash = w.hashes()
        self.lex_base = base + 4 * (1 << AFFIX_BITS)

    def lexicon(self, known: np.ndarray) -> np.ndarray:
        """Index of a word's lexicon entry, or that of unknown words."""
        if not len(known):
            return np.full(len(self.hash), self.lex_base + (1 << LEX_BITS))
        at = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
        slot = self.lex_base + at % (1 << LEX_BITS)
        return np.where(known[at] == self.hash, slot, self.lex_base + (1 << LEX_BITS))

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, length) of every chain: a line's words, cut at CHAIN."""
        w = self.words
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lines = np.concatenate(([0], np.cumsum(w.data == 0x0A)))
        line = lines[w.start]
        new = np.concatenate(([True], (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])))
        start = np.flatnonzero(new)
        place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
        start = np.flatnonzero(place % CHAIN == 0)
        return start, np.diff(np.append(start, len(w)))


def _fold(x: np.ndarray, bits: int) -> np.ndarray:
    return (x * 0x9E3779B1 >> 8) & ((1 << bits) - 1)


class Crf:
    """The weights: a table (feature, language), transitions, and the lexicon."""

    def __init__(self, langs: list[str], known: np.ndarray):
        self.langs, self.known = langs, known
        k = len(langs)
        self.table = np.zeros((Features.SIZE, k), dtype=np.float32)
        self.moves = np.eye(k, dtype=np.float64)      # transition weights

    def emissions(self, f: Features) -> np.ndarray:
        n, k = len(f.words), len(self.langs)
        out = np.zeros((n, k))
        if not n:
            return out
        for idx in [*f.word, f.lexicon(self.known)]:
            out += self.table[idx]
        per_byte = self.table[f.byte[0]] + self.table[f.byte[1]]
        return out + np.add.reduceat(per_byte, f.first, axis=0)

    def marginals(self, em: np.ndarray, start: np.ndarray, length: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over all chains at once: each word's label
        probabilities, and the expected transitions summed over all words."""
        k = len(self.langs)
        seen = np.exp(em - em.max(1, keepdims=True)) if len(em) else em
        move = np.exp(self.moves)
        order = np.argsort(-length, kind="stable")
        first, size = start[order], length[order]
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
        ahead = np.empty((len(em), k))
        back = np.ones((len(em), k))
        now = None
        for t in range(longest):
            m = alive[t]
            at = first[:m] + t
            now = seen[at] if now is None else (now[:m] @ move) * seen[at]
            now = now / now.sum(1, keepdims=True)
            ahead[at] = now
        pairs = np.zeros((k, k))
        later = np.zeros((0, k))
        for t in range(longest - 1, 0, -1):
            m = alive[t]
            at = first[:m] + t
            held = np.ones((m, k))
            held[:len(later)] = later
            weight = held * seen[at]
            later = weight @ move.T
            joint = ahead[at - 1] * later
            norm = joint.sum(1, keepdims=True)
            pairs += move * ((ahead[at - 1] / norm).T @ weight)
            later = later / later.sum(1, keepdims=True)
            back[at - 1] = later
        post = ahead * back
        return post / post.sum(1, keepdims=True) if len(post) else post, pairs

    def fit(self, f: Features, label: np.ndarray, rounds: int = ROUNDS) -> None:
        """Gradient ascent on the chains' log-likelihood, with steps scaled by
        the gradients met so far."""
        k = len(self.langs)
        start, length = f.chains()
        target = np.eye(k)[label]
        inner = np.ones(len(label), dtype=bool)
        inner[start] = False
        after = np.flatnonzero(inner)
        true_pairs = np.zeros((k, k))
        np.add.at(true_pairs, (label[after - 1], label[after]), 1)
        lex = f.lexicon(self.known)
        size = np.zeros_like(self.table)
        move_size = np.zeros((k, k))
        for _ in range(rounds):
            post, pairs = self.marginals(self.emissions(f), start, length)
            off = target - post
            for j in range(k):
                grad = sum(np.bincount(idx, off[:, j], Features.SIZE) for idx in [*f.word, lex])
                spread = off[f.of, j]
                for idx in f.byte:
                    grad += np.bincount(idx, spread, Features.SIZE)
                grad -= 0.05 * self.table[:, j]
                size[:, j] += grad ** 2
                self.table[:, j] += 0.3 * grad / np.sqrt(size[:, j] + 1e-6)
            move = true_pairs - pairs
            move_size += move ** 2
            self.moves += 0.3 * move / np.sqrt(move_size + 1e-6)
        # texts of one language teach no change of it: keep a switch possible
        self.moves = np.clip(self.moves, self.moves.max() - 5.0, None)


def train(rows: list[tuple[str, str]]) -> Crf | None:
    """A model from (text, language) rows; every word takes its text's
    language."""
    rows = [r for r in rows if r[0] and r[1] is not None]
    if not rows:
        return None
    langs = sorted({lang for _, lang in rows})
    text = pa.array([t for t, _ in rows], pa.large_string())
    (_, data, offsets), = string_slices(text, 1 << 62)
    f = Features(data, offsets)
    label = np.array([langs.index(lang) for _, lang in rows])[f.words.row]
    known, n = np.unique(f.hash, return_counts=True)
    model = Crf(langs, known[n > 1])
    if len(f.words):
        model.fit(f, label)
    return model


def training_rows(labelled: DataFrame, text_col: str, lang_col: str,
                  max_texts: int = TRAIN_TEXTS) -> list[tuple[str, str]]:
    """The bounded sample: texts with the least hashes of their language."""
    named = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"),
        F.xxhash64(text_col, F.lit("sample")).alias("h"))
    counts = {r["l"]: r["n"] for r in
              named.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    each = max(1, max_texts // len(counts))
    share = F.create_map(*[x for lang, n in counts.items()
                           for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    picked = named.where(F.pmod(F.col("h"), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20))
    return [(r["t"], r["l"]) for r in picked.groupBy("l", "h").agg(F.first("t").alias("t"))
            .orderBy("h").limit(2 * max_texts).collect()]


def identify(docs: DataFrame, model: Crf | None, text_col: str = "text", *,
             spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; with ``spans`` also the runs
    of words of one label, as (start, end, lang) in code points."""
    bounded_batches(docs.sparkSession)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("lang", T.StringType())])
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(span)))
    schema = schema_with(docs, *fields)
    order = [f.name for f in schema.fields[:-len(fields)]]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = held.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            lang, score, runs = [], [], []
            for row, data, offsets in string_slices(texts):
                n = len(offsets) - 1
                if crf is None:
                    lang += [UNKNOWN] * n
                    score += [0.0] * n
                    runs += [[]] * n
                    continue
                f = Features(data, offsets)
                post, _ = crf.marginals(crf.emissions(f), *f.chains())
                total = np.stack([np.bincount(f.words.row, post[:, j], n)
                                  for j in range(len(crf.langs))], 1)
                words = np.maximum(f.words.per_row(), 1)
                best = total.argmax(1)
                worth = np.clip(total[np.arange(n), best] / words, 0, 1)
                for i in range(n):
                    text = texts[row + i].as_py()
                    letters = text is not None and _LETTER.search(text) is not None
                    lang.append(crf.langs[best[i]] if letters else UNKNOWN)
                    score.append(float(worth[i]) if letters else 0.0)
                if spans:
                    runs += _spans(f, post, crf.langs, n)
            cols = b.columns[:len(order)]
            cols += [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array(runs, pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(cols, names=order + [x.name for x in fields])

    return docs.select(*order, F.col(text_col).alias(fresh(docs, "_text"))).mapInArrow(run, schema)


def _spans(f: Features, post: np.ndarray, langs: list[str], n: int) -> list[list[dict]]:
    w = f.words
    out: list[list[dict]] = [[] for _ in range(n)]
    if not len(w):
        return out
    label = post.argmax(1)
    point = np.concatenate(([0], np.cumsum(code_points(w.data), dtype=np.int64)))
    new = np.concatenate(([True], (label[1:] != label[:-1]) | (w.row[1:] != w.row[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(w)) - 1
    for a, b in zip(first.tolist(), last.tolist()):
        r = int(w.row[a])
        base = point[w.offsets[r]]
        out[r].append({"start": int(point[w.start[a]] - base), "end": int(point[w.end[b]] - base),
                       "lang": langs[label[a]]})
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
