"""Secret scan: fixed patterns, and credential formats learned by grammar
inference.

Base kinds are found by pattern (``BASE``). Their matches are labelled
credentials: per kind, strings over character classes go into a prefix tree,
and states whose outgoing frequencies do not differ more than chance allows
(Hoeffding bound) are merged, deterministically and from the root on. What
remains is a probabilistic automaton of the format. One more is learned from
ordinary tokens. Every token of ``MIN_TOKEN`` characters or more outside the
base spans is then scored by its log-likelihood per character under each format
against that of ordinary tokens, and reported as kind ``format`` if it passes
the bar of its length band: of 16 characters or more, above 99 of 100 ordinary
tokens and no worse than nearly all credentials; shorter ones, which
say less, above all ordinary tokens of their band and by a likelihood ratio of
at least e to the ``SHORT_RATIO``. Tokens that score like a labelled format are
not counted as ordinary, so bare credentials in the sample do not hide others.

The automata are fitted on a bounded sample: at most ``TRAIN_EACH`` distinct
strings a kind, and as many ordinary tokens a length band, chosen by hash from
all matches of all documents. The scan is a pass over all whole texts; a task
holds one slice. The automata see characters as classes, so a task scores each
string of classes once and knows its other tokens by array operations.

Offsets are code points, end exclusive. Null and empty texts have no spans. In
a table without matches nothing is learned and only the base patterns apply.
Repeated rows are scanned each, an empty table gives an empty table, other columns
pass through (one named ``spans`` gives way to the result).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, fresh, schema_with, written
from rollcall.llm.words import Words, code_points, string_slices

# The base patterns and the least length of what they match.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                          r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = [*BASE, "format"]

MIN_TOKEN = 6
#: least lengths of the bands that have a bar each; the last is that of long tokens
BANDS = (6, 8, 12, 16)
LONG = 16
#: natural logarithm of the likelihood ratio a shorter token must reach
SHORT_RATIO = 14.0
#: distinct strings a kind is learned from, at most
TRAIN_EACH = 300
#: confidence of the merge test
ALPHA = 0.05
_WORDS = (b"passw", b"secret", b"token", b"api")

_TOKEN = np.ones(256, dtype=bool)           # separators of tokens
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = False
_TAIL = np.zeros(256, dtype=bool)            # what a sentence or a key leaves at the end
_TAIL[list(b".=")] = True
_CLASS = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdef"},
                        **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEF"},
                        **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}, **{c: "/" for c in "+/"},
                        **{c: "-" for c in "_-."}})
SYMBOLS = 8
_CLASS_BYTE = np.array([ord(chr(c).translate(_CLASS)) if c < 128 else 1 for c in range(256)], dtype=np.uint8)


def band(length: int) -> int:
    return sum(length >= b for b in BANDS) - 1


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns, leftmost and not
    overlapping within a kind."""
    found = []
    folded = text.encode("utf-8").lower()
    for kind, (pattern, group, least) in BASE.items():
        if kind == "access" and "AKIA" not in text:
            continue
        if kind == "assign" and not any(word in folded for word in _WORDS):
            continue
        for m in pattern.finditer(text):
            if len(m.group(group)) >= least:
                found.append((m.start(), m.end(), kind, m.group(group)))
    return found


# -- automata ---------------------------------------------------------------------

class Automaton:
    """A probabilistic automaton learned by merging prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            q = 0
            for c in s.translate(_CLASS):
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                self.count[q][c] = self.count[q].get(c, 0) + 1
                q = self.next[q][c]
            self.ends[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _alike(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            slack = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > slack:
                return False
            for c in set(self.count[a]) | set(self.count[b]):
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > slack:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    stack.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red, known = [0], {0}
        while True:
            blue = [(q, c) for q in red for c in sorted(self.next[q]) if self.next[q][c] not in known]
            if not blue:
                return
            q, c = max(blue, key=lambda x: (self._total(self.next[x[0]][x[1]]), -x[0]))
            b = self.next[q][c]
            for r in red:
                if self._alike(r, b):
                    self.next[q][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
                known.add(b)

    def score(self, s: str, end: bool = True) -> float:
        """Log-likelihood per character, the end counted as one unless ``end``
        is false; what was never seen has a small probability."""
        q, total = 0, 0.0
        for c in s.translate(_CLASS):
            n = self._total(q)
            total += math.log((self.count[q].get(c, 0) + 0.05) / (n + 0.05 * (SYMBOLS + 1)))
            q = self.next[q].get(c, q)
        if not end:
            return total / max(1, len(s))
        n = self._total(q)
        total += math.log((self.ends[q] + 0.05) / (n + 0.05 * (SYMBOLS + 1)))
        return total / (len(s) + 1)


class Formats:
    """The automata and the bar a token of each length band must pass."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        held = [v for v in labelled.values() if v]
        self.kinds = [Automaton(v) for v in held]
        ordinary = self._without_formats(held, ordinary)
        self.usual = Automaton(ordinary)
        self.bars = []
        for b, low in enumerate(BANDS):
            gains = sorted(self.gain(s) for s in ordinary if band(len(s)) == b)
            if low < LONG:
                self.bars.append(max([0.5, *(g + 0.1 for g in gains[-1:])]))
                continue
            # above 99 of 100 ordinary tokens, so no single one sets the bar
            gains = sorted(self.gain(s) for s in ordinary if len(s) >= LONG - 4)
            bar = max([0.5, *(g + 0.1 for g in gains[(len(gains) - 1) * 99 // 100:][:1])])
            own = [sorted(self.gain(s) for s in v if len(s) >= LONG) for v in held]
            own = [g[len(g) // 50] for g in own if g]
            # and nearer to what 98 of 100 credentials of a kind reach
            self.bars.append(max(bar, (bar + min(own)) / 2) if own else bar)

    def _without_formats(self, held: list[list[str]], ordinary: list[str]) -> list[str]:
        """``ordinary`` without the tokens that are of a labelled format: their
        characters score like those of its credentials, no worse and no
        better (digits alone are not like hexadecimal keys; a mean over fewer
        characters spreads more), and better than under what the remaining
        tokens are like. A kind that leaves less than a fifth of the tokens
        looks like ordinary text itself and takes none."""
        likeness: dict[str, float] = {}
        for a, v in zip(self.kinds, held):
            scores = sorted(a.score(s, end=False) for s in v)
            low, middle, high = (scores[i] for i in (0, len(v) // 2, -1 - len(v) // 100))
            usual_length = sum(map(len, v)) / len(v)
            like = {}
            for s in ordinary:
                x = a.score(s, end=False)
                wide = max(1, usual_length / len(s)) ** 0.5
                if (low - middle) * wide <= x - middle <= (high - middle) * wide:
                    like[s] = x
            if len(ordinary) - len(like) >= len(ordinary) / 5:
                likeness.update((s, max(x, likeness.get(s, x))) for s, x in like.items())
        rest = Automaton([s for s in ordinary if s not in likeness])
        return [s for s in ordinary if s not in likeness or likeness[s] - rest.score(s, end=False) <= 0.5]

    def gain(self, s: str) -> float:
        return max(a.score(s) for a in self.kinds) - self.usual.score(s)

    def accepts(self, s: str) -> bool:
        if len(s) < MIN_TOKEN:
            return False
        gain = self.gain(s)
        return gain > self.bars[band(len(s))] and (len(s) >= LONG or gain * (len(s) + 1) >= SHORT_RATIO)


# -- Spark ------------------------------------------------------------------------

def _tokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The tokens of a slice, without full stops and equal signs at the end."""
    w = Words(data, offsets, separators=_TOKEN)
    if len(w):
        here = np.where(w.inside & ~_TAIL[data], np.arange(len(data)), -1)
        end = np.maximum(np.maximum.accumulate(here)[w.end - 1] + 1, w.start)
        cut = np.zeros(len(data) + 1, dtype=np.int64)
        np.add.at(cut, end, 1)
        np.add.at(cut, w.end, -1)
        w.inside = w.inside & (np.cumsum(cut)[:-1] == 0)
        w.full, w.end = w.end, end
    return w


def _rows_with_base(data: np.ndarray, offsets: np.ndarray, w: Words) -> set[int]:
    """Rows that may have a base span: with a key word or a long token."""
    rows = set(w.row[np.flatnonzero(w.full - w.start >= 20)].tolist()) if len(w) else set()
    folded = data.tobytes().lower()
    for word in _WORDS:
        at = folded.find(word)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            rows.add(row)
            at = folded.find(word, int(offsets[row + 1]))
    return rows


class _Judge:
    """Which tokens of a task's slices the formats accept."""

    #: class strings remembered
    MEMORY = 500_000

    def __init__(self, learned: Formats):
        self.learned = learned
        self.known: dict[int, bool] = {}

    def accepted(self, data: np.ndarray, w: Words) -> np.ndarray:
        """Numbers of the accepted tokens, in order."""
        at = np.flatnonzero(w.end - w.start >= MIN_TOKEN) if len(w) else np.zeros(0, np.int64)
        if not len(at):
            return at
        plain, w.data = w.data, _CLASS_BYTE[data]
        hashes = w.hashes()[at]
        w.data = plain
        values, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        told = np.zeros(len(values), dtype=bool)
        for k, (h, i) in enumerate(zip(values.tolist(), at[first].tolist())):
            if h not in self.known:
                if len(self.known) >= self.MEMORY:
                    self.known.clear()
                self.known[h] = self.learned.accepts(data[w.start[i]:w.end[i]].tobytes().decode("ascii"))
            told[k] = self.known[h]
        return at[told[which]]


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=7).digest(), "big")


def _by_hash(x: tuple[str, int]) -> tuple[int, str]:
    return x[1], x[0]


def labelled_strings(docs: DataFrame, text_col: str) -> tuple[dict[str, list[str]], list[str]]:
    """The bounded training sample: credentials of each base kind, and long
    ordinary tokens."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary: list[dict[str, int]] = [{} for _ in BANDS]      # the task's least hashes
        most = np.full(len(BANDS), 1 << 62)

        def least(held: dict[str, int]) -> dict[str, int]:
            return dict(sorted(held.items(), key=_by_hash)[:TRAIN_EACH])

        for b in batches:
            rows: set[tuple[str, str]] = set()
            for row, data, offsets in string_slices(b.column(0)):
                w = _tokens(data, offsets)
                taken = {}
                for r in _rows_with_base(data, offsets, w):
                    spans = base_spans(b.column(0)[row + r].as_py() or "")
                    taken[r] = {s for *_, s in spans}
                    rows.update((kind, s) for _, _, kind, s in spans if len(s) <= 128)
                if not len(w):
                    continue
                size = w.end - w.start
                of = np.searchsorted(BANDS, size, side="right") - 1
                hashes = (w.hashes() >> np.uint64(2)).astype(np.int64)
                for i in np.flatnonzero((of >= 0) & (size <= 128) & (hashes < most[of])).tolist():
                    k, h = int(of[i]), int(hashes[i])
                    if h >= most[k]:
                        continue
                    s = data[w.start[i]:w.end[i]].tobytes().decode("ascii")
                    if not any(x in s or s in x for x in taken.get(int(w.row[i]), ())):
                        ordinary[k][s] = h
                        if len(ordinary[k]) >= 2 * TRAIN_EACH:
                            ordinary[k] = least(ordinary[k])
                            most[k] = max(ordinary[k].values())
            if rows:
                yield batch({(kind, s, _hash(s)) for kind, s in rows})
        yield batch({(f"band {k}", s, h) for k, held in enumerate(ordinary) for s, h in least(held).items()})

    def batch(rows: set[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["kind", "s", "h"])

    seen = written(docs.select(text_col).mapInArrow(run, "kind string, s string, h long")
                   .groupBy("kind", "s").agg(F.first("h").alias("h")), "secret-strings")
    out: dict[str, list[str]] = {}
    for kind in [*BASE, *(f"band {k}" for k in range(len(BANDS)))]:   # ordered by hash: a fixed, even sample
        rows = seen.where(F.col("kind") == kind).orderBy("h", "s").limit(TRAIN_EACH).collect()
        out[kind] = [r["s"] for r in rows]
    return {k: v for k, v in out.items() if k in BASE}, [s for k, v in out.items() if k not in BASE for s in v]


def learn_formats(docs: DataFrame, text_col: str = "text") -> Formats | None:
    """The automata, or None when there is nothing to learn from."""
    labelled, ordinary = labelled_strings(docs, text_col)
    if not any(labelled.values()):
        return None
    return Formats(labelled, ordinary)


def find_secrets(docs: DataFrame, formats: Formats | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (kind, start, end) by start, then by kind in
    the order of ``KINDS``."""
    bounded_batches(docs.sparkSession)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])
    schema = schema_with(docs, T.StructField("spans", T.ArrayType(span)))
    order = [f.name for f in schema.fields[:-1]]
    held = docs.sparkSession.sparkContext.broadcast(formats)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(held.value) if held.value is not None else None
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for row, data, offsets in string_slices(texts):
                w = _tokens(data, offsets)
                tried: dict[int, list[int]] = {}
                for i in judge.accepted(data, w).tolist() if judge is not None else ():
                    tried.setdefault(int(w.row[i]), []).append(i)
                base = _rows_with_base(data, offsets, w)
                for r in sorted(base | set(tried)):
                    text = texts[row + r].as_py() or ""
                    spans = [s[:3] for s in base_spans(text)] if r in base else []
                    if r in tried:
                        spans += _learned(text, data, offsets, w, tried[r], r, spans)
                    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                    out[row + r] = [{"kind": k, "start": s, "end": e} for s, e, k in spans]
            yield pa.RecordBatch.from_arrays(
                b.columns[:len(order)] + [pa.array(out, kind_type)],
                names=order + ["spans"])

    return docs.select(*order, F.col(text_col).alias(fresh(docs, "_text"))).mapInArrow(run, schema)


def _learned(text: str, data: np.ndarray, offsets: np.ndarray, w: Words, tokens: list[int], row: int,
             base: list[tuple]) -> list[tuple[int, int, str]]:
    """Spans of accepted tokens, in order, that no base span covers."""
    raw = data[offsets[row]:offsets[row + 1]]
    point = None if len(raw) == len(text) else np.concatenate(([0], np.cumsum(code_points(raw))))
    # base spans that overlap, as one list of disjoint ones in order
    taken: list[list[int]] = []
    for a, e, _ in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([a, e])
    found, k = [], 0
    for i in tokens:
        a, e = int(w.start[i] - offsets[row]), int(w.end[i] - offsets[row])
        if point is not None:
            a, e = int(point[a]), int(point[e])
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            found.append((a, e, "format"))
    return found
