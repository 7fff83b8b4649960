"""Token ids of whole texts, with a memory for words.

White space never joins two tokens of the vocabularies used here (it is
dropped, or ends a word), so a text's ids are those of its white-space
separated pieces, one after the other; ``word_wise`` says whether this holds
for a tokenizer, and where it doesn't, texts are encoded whole. Pieces repeat
a lot, so each worker keeps the ids of those it has met (bounded, the least
recently met go first), as sorted arrays searched for all pieces of a group of
texts at once. A piece is known by its 64-bit hash together with its length and
first eight bytes. A new piece that is a plain word with commas or full stops
after it is looked up as the word and its tail. Every id comes from the
tokenizers library.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from rollcall.llm.words import Words, string_slices

#: pieces kept per worker (about 60 bytes each), and plain words kept besides
MEMORY = 1_500_000
WORDS = 250_000
#: bytes of text whose new pieces are encoded in one call
GROUP_BYTES = 4 << 20


def word_wise(config: dict) -> bool:
    """True when no token can hold or cross white space: the pre-tokenizer
    keeps only matches of a pattern (inverted, removed) and each alternative
    of the pattern leaves white space out."""
    norm = json.dumps(config.get("normalizer") or {})
    pre = config.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    splits = (first.get("type") == "Split" and first.get("invert") is True
              and first.get("behavior") == "Removed")
    if not splits or "Prepend" in norm or config.get("post_processor"):
        return False
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    parts = pattern.replace(r"[^\s\p{L}\p{N}]+", "").replace(r"[\p{L}]+", "").replace(r"[\p{N}]", "")
    added = any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                for t in config.get("added_tokens") or [])
    return not added and "\\s" not in parts and " " not in parts and "[" not in parts and "." not in parts


class Encoder:
    """Ids of texts by a tokenizer file, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark runs the cores
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.word_wise = word_wise(config)
        self.folds = "Lowercase" in json.dumps(config.get("normalizer") or {})
        self.words: dict[bytes, bytes] = {}
        self.hash = np.zeros(0, np.uint64)      # sorted; the others run along
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)      # place in pool
        self.size = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)        # the last group it was met in
        self.pool = np.zeros(0, "<u4")
        self.group = 0

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null is empty)."""
        if not isinstance(texts, (pa.Array, pa.ChunkedArray)):
            texts = pa.array(texts, pa.large_string())
        if not self.word_wise:
            return self._encode([t or "" for t in texts.to_pylist()])
        out: list[bytes] = []
        for _, data, offsets in string_slices(texts, GROUP_BYTES):
            out += self._group(data, offsets)
        return out

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        w = Words(data, offsets)
        if not len(w):
            return [b""] * w.rows
        self.group += 1
        values, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
        check = self._checks(w, first)
        at = np.minimum(np.searchsorted(self.hash, values), max(len(self.hash) - 1, 0))
        known = (self.hash[at] == values) & (self.check[at] == check) if len(self.hash) \
            else np.zeros(len(values), bool)
        start, size = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        start[known], size[known] = self.start[at[known]], self.size[at[known]]
        self.met[at[known]] = self.group
        pool = self.pool
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            ids = self._learn([raw[s:e] for s, e in zip(w.start[first[new]].tolist(),
                                                        w.end[first[new]].tolist())])
            size[new] = [len(i) // 4 for i in ids]
            start[new] = len(pool) + np.cumsum(size[new]) - size[new]
            pool = np.concatenate((pool, np.frombuffer(b"".join(ids), "<u4")))
            self.pool = pool
            self._keep(values[new], check[new], start[new], size[new])
        # every piece's ids, one after the other
        n, at = size[which], start[which]
        ends = np.cumsum(n)
        flat = pool[np.arange(int(ends[-1])) + np.repeat(at - (ends - n), n)]
        cuts = np.concatenate(([0], ends))[w.first()].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _checks(w: Words, first: np.ndarray) -> np.ndarray:
        """Length and the first eight bytes of a piece, in 64 bits."""
        s, e = w.start[first], w.end[first]
        out = (e - s).astype(np.uint64) << np.uint64(56)
        for j in range(8):
            here = s + j < e
            byte = np.where(here, w.data[np.minimum(s + j, len(w.data) - 1)], 0).astype(np.uint64)
            out ^= byte << np.uint64(8 * j)
        return out

    def _keep(self, values, check, start, size) -> None:
        at = np.searchsorted(self.hash, values)
        self.hash, self.check, self.start, self.size, self.met = (
            np.insert(a, at, b) for a, b in (
                (self.hash, values), (self.check, check), (self.start, start), (self.size, size),
                (self.met, np.full(len(values), self.group))))
        if len(self.hash) > MEMORY:      # the half met last stays
            stay = self.met > np.partition(self.met, MEMORY // 2)[MEMORY // 2]
            n, at = self.size[stay], self.start[stay]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            self.pool = self.pool[np.arange(total) + np.repeat(at - (ends - n), n)]
            self.start, self.size = ends - n, n
            self.hash, self.check, self.met = self.hash[stay], self.check[stay], self.met[stay]

    def _parts(self, piece: bytes) -> tuple[bytes, bytes]:
        """(word, tail): the piece's ids are the word's and then the tail's."""
        word = piece.rstrip(b".,")
        if word.isalnum():                       # ASCII letters and digits only
            return (word.lower() if self.folds else word), piece[len(word):]
        if word and len(word) < len(piece) and not word.isascii():
            last = word.decode("utf-8")[-1]
            if last.isalpha() and last < "\u0250":
                return word, piece[len(word):]
        return piece, b""

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of pieces that are not in the arrays."""
        parts = [self._parts(p) for p in new]
        words = self.words
        ask = list({x for pair in parts for x in pair if x and x not in words})
        have = dict(zip(ask, self._encode([x.decode("utf-8") for x in ask])))
        have[b""] = b""
        out = [(have[w] if w in have else words[w]) + (have[t] if t in have else words[t])
               for w, t in parts]
        if len(words) + len(have) > WORDS:
            words.clear()
        words.update(have)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file: what it has learned serves
    the worker's later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
