"""Cheapest edits of role/fault sequences: a grammar-compressed dynamic program.

A row is one of nine symbols: its role's initial (s, u, a or another) with
or without a truncated text, or a row that must go. Edits are Keep (0), Rerole
to u or a (2), Delete (3), Insert u or a (2), and an undeleted truncated row adds
1; the roles that stay must read ``(s?(ua)+)?``, an automaton of four states.
For a sequence of rows, entry [i][j] of its matrix is the cheapest way from state
i to state j and the audit of its edits, the ASCII-least one of equal cost;
matrices multiply in the min-plus sense, audits by concatenation. This is exact:
of two audits of the same rows with equal cost neither is a proper prefix of
the other (what it lacks would be inserts, and they cost), so the least audit of
a whole is made of least audits.

Sequences are compressed by Re-Pair: the most frequent pair of neighbours
becomes a new symbol, again and again. Each rule then has one matrix, the product
of its two symbols', whatever the number of places it stands for; audits are
ropes, so a product copies no text. A sequence is folded over what is left of it.
"""

from __future__ import annotations

import numpy as np

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1

#: nothing yet, after s, after u, after a
STATES = 4
ACCEPTING = (0, 3)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

#: a pair becomes a rule if it stands in so many places (this sets the cost of
#: the fold, not its result)
MIN_USES = 8

#: factors that are multiplied one after the other
FOLD = 16

_MOD = (1 << 61) - 1
_BASE = 1_000_003


class Rope:
    """A text as a tree of pieces, with a hash to compare it by."""

    __slots__ = ("left", "right", "text", "size", "hash", "power")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.size = len(text)
            self.hash = 0
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _MOD
            self.power = pow(_BASE, self.size, _MOD)
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * right.power + right.hash) % _MOD
            self.power = left.power * right.power % _MOD

    def __add__(self, other: Rope) -> Rope:
        if not self.size:
            return other
        if not other.size:
            return self
        if self.size + other.size <= 32:
            return Rope(str(self) + str(other))
        return Rope("", self, other)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                out.append(r.text)
            else:
                todo += [r.right, r.left]
        return "".join(out)

    def head(self, n: int) -> int:
        """Hash of the first n characters."""
        out, r = 0, self
        while True:
            if n == r.size:
                return (out * r.power + r.hash) % _MOD
            if r.left is None:
                return (out * pow(_BASE, n, _MOD) + Rope(r.text[:n]).hash) % _MOD
            if n <= r.left.size:
                r = r.left
            else:
                out = (out * r.left.power + r.left.hash) % _MOD
                n -= r.left.size
                r = r.right

    def at(self, i: int) -> str:
        r = self
        while r.left is not None:
            if i < r.left.size:
                r = r.left
            else:
                i -= r.left.size
                r = r.right
        return r.text[i]

    def __lt__(self, other: Rope) -> bool:
        """ASCII order: the first difference is found by hashes of prefixes, in
        steps that grow with the logarithm of the length, not the length."""
        if self is other or (self.size == other.size and self.hash == other.hash):
            return False
        if self.left is None and other.left is None:
            return self.text < other.text
        n, same, step = min(self.size, other.size), 0, 16
        while same + step <= n and self.head(same + step) == other.head(same + step):
            same, step = same + step, 2 * step
        differ = min(same + step, n)
        if self.head(differ) == other.head(differ):
            return self.size < other.size
        while differ - same > 1:           # equal up to same, different at differ
            mid = (same + differ) // 2
            if self.head(mid) == other.head(mid):
                same = mid
            else:
                differ = mid
        return self.at(same) < other.at(same)


EMPTY = Rope()

#: state -> (cost, audit) from one state; a matrix is one of these per state
Vector = dict[int, tuple[int, Rope]]


def _better(out: Vector, state: int, cost: int, audit: Rope) -> None:
    have = out.get(state)
    if have is None or cost < have[0] or (cost == have[0] and audit < have[1]):
        out[state] = (cost, audit)


def times(vector: Vector, matrix: list[Vector]) -> Vector:
    out: Vector = {}
    for k, (cost, audit) in vector.items():
        for j, (more, rest) in matrix[k].items():
            have = out.get(j)
            if have is None or cost + more <= have[0]:
                _better(out, j, cost + more, audit + rest)
    return out


def product(a: list[Vector], b: list[Vector]) -> list[Vector]:
    return [times(v, b) for v in a]


def _inserts() -> list[Vector]:
    """Up to two inserts: more lead back to a state already reached for less."""
    out: list[Vector] = []
    for i in range(STATES):
        reach: Vector = {i: (0, EMPTY)}
        frontier, audit = [i], ""
        for n in (1, 2):
            audit += INSERT
            frontier = [AFTER[k, r] for k in frontier for r in "ua" if (k, r) in AFTER]
            for k in frontier:
                _better(reach, k, n * COST[INSERT], Rope(audit))
        out.append(reach)
    return out


INSERTS = _inserts()
#: symbols: 2 * place in "sua" (3: another initial) + truncated; 8 must go
MUST_GO = 8


def symbol(initial: str, truncated: bool) -> int:
    return 2 * ("sua".find(initial) if initial and initial in "sua" else 3) + truncated


def _edited(sym: int) -> list[Vector]:
    own, extra = "sua-"[min(sym // 2, 3)], TRUNCATED * (sym % 2)
    out: list[Vector] = []
    for i in range(STATES):
        v: Vector = {}
        _better(v, i, COST[DELETE], Rope(DELETE))
        if sym != MUST_GO:
            for role, edit in [(own, KEEP), ("u", REROLE), ("a", REROLE)]:
                if (i, role) in AFTER:
                    _better(v, AFTER[i, role], COST[edit] + extra, Rope(edit))
        out.append(v)
    return out


#: the matrix of each symbol: inserts, then the row's edit
BASE = [product(INSERTS, _edited(s)) for s in range(MUST_GO + 1)]


def re_pair(sequences: list[bytes]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (pairs, numbered from 9 on) and the sequences over them."""
    ends = np.cumsum([len(s) + 1 for s in sequences])
    flat = np.full(int(ends[-1]), -1, np.int64)
    for s, e in zip(sequences, ends.tolist()):
        flat[e - 1 - len(s):e - 1] = np.frombuffer(s, np.uint8)
    rules: list[tuple[int, int]] = []
    while True:
        size = len(BASE) + len(rules)
        a, b = flat[:-1], flat[1:]
        pair = np.where((a >= 0) & (b >= 0), a * size + b, size * size)
        uses = np.bincount(pair, minlength=size * size + 1)[:-1]
        if not len(uses) or uses.max() < MIN_USES:
            break
        x, y = divmod(int(uses.argmax()), size)
        at = np.flatnonzero(pair == x * size + y)
        if x == y:                     # every other place of a run
            first = np.concatenate(([True], np.diff(at) > 1))
            starts = np.flatnonzero(first)
            at = at[(np.arange(len(at)) - starts[np.cumsum(first) - 1]) % 2 == 0]
        rules.append((x, y))
        flat[at] = size
        flat = np.delete(flat, at + 1)
    cuts = np.flatnonzero(flat < 0)
    return rules, [p[p >= 0].tolist() for p in np.split(flat, cuts)[:len(sequences)]]


class Grammar:
    """A grammar over some sequences, with the matrix of every symbol."""

    def __init__(self, sequences: list[bytes]):
        distinct = list(dict.fromkeys(sequences))
        rules, over = re_pair(distinct) if distinct else ([], [])
        self.over = dict(zip(distinct, over))
        self.matrix = list(BASE)
        for x, y in rules:
            self.matrix.append(product(self.matrix[x], self.matrix[y]))
        self._from_start: dict[bytes, Vector] = {}

    def fold(self, vector: Vector, sequence: bytes) -> Vector:
        """``vector`` after the sequence; a long one by halves, so that ropes
        stay shallow."""
        factors = [self.matrix[s] for s in self.over[sequence]]
        while len(factors) > FOLD:
            pairs = [product(a, b) for a, b in zip(factors[::2], factors[1::2])]
            factors = pairs + factors[len(factors) & ~1:]
        for m in factors:
            vector = times(vector, m)
        return vector

    def from_start(self, sequence: bytes) -> Vector:
        """The fold from the first state: once for all equal sequences."""
        if sequence not in self._from_start:
            self._from_start[sequence] = self.fold({0: (0, EMPTY)}, sequence)
        return self._from_start[sequence]


def finished(vector: Vector) -> tuple[int, str]:
    """Cost and audit of the cheapest way to an accepting state."""
    out: Vector = {}
    closed = times(vector, INSERTS)
    for j in ACCEPTING:
        if j in closed:
            _better(out, 0, *closed[j])
    cost, audit = out[0]
    return cost, str(audit)
