"""Quality rules combined by weak supervision.

Every rule looks at counts of a text and votes good, bad, or abstains. How far
each rule can be trusted is estimated by expectation-maximisation over the
votes of all documents: per rule and class, how often it votes good, bad, or
abstains (with a prior worth a fixed, small number of documents), and the share
of good documents. A document's verdict is its
posterior probability of being good under those estimates.

The documents meet the fit only as a histogram of vote patterns (one group
per pattern, at most 3^rules, counted with a map-side combine over all rows),
so the fit costs the same at any size and is exact: it is the fit over all
documents. The histogram is the only thing the driver sees.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. Null and empty texts have
no words and all counts 0. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import bounded_batches, fresh, schema_with, written
from rollcall.llm.words import Words, code_points, mix, string_slices

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:;\"')")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_stop_lines", "n_letters", "n_upper", "n_letter_words"]

#: a document is kept from this posterior probability on
MIN_POSTERIOR = 0.5
EM_ROUNDS = 100


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts the rules look at, one value per text."""
    out = {c: np.zeros(len(texts), dtype=np.int64) for c in COUNTS}
    for row, data, offsets in string_slices(texts):
        for name, vals in _slice_counts(data, offsets).items():
            out[name][row:row + len(vals)] = vals
    return out


def _slice_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(data, offsets)
    lines = Words(data, offsets, separators=_NEWLINE)
    rows = w.rows

    def total(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return run[offsets[1:]] - run[offsets[:-1]]

    letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    res = {
        "n_words": w.per_row(),
        "word_chars": total(code_points(data) & w.inside),
        "n_symbols": total(_SYMBOL[data]),
        "n_letters": total(_LETTER[data] & code_points(data)),
        "n_upper": total(_UPPER[data]),
        "n_letter_words": w.per_row(w.row[letters[w.end] > letters[w.start]]),
    }
    # words in 3-word windows that occur twice or more in their text
    at, grams = w.ngrams(w.hashes(), 3)
    hit = np.zeros(len(w), dtype=bool)
    if len(at):
        again = _repeated(mix(grams + w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        for j in range(3):
            hit[at[again] + j] = True
    res["n_repeat_words"] = w.per_row(w.row[hit])
    # lines with a word, and those equal to an earlier line of the text
    inside = np.concatenate(([0], np.cumsum(w.inside, dtype=np.int64)))
    full = inside[lines.end] > inside[lines.start]
    keys = mix(lines.hashes() + lines.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys, line_row = keys[full], lines.row[full]
    dup = np.ones(len(keys), dtype=bool)
    dup[np.unique(keys, return_index=True)[1]] = False
    res["n_lines"] = np.bincount(line_row, minlength=rows).astype(np.int64)
    res["n_dup_lines"] = np.bincount(line_row[dup], minlength=rows).astype(np.int64)
    stop = _STOP[data[np.maximum(lines.end - 1, 0)]] if len(lines) else np.zeros(0, bool)
    res["n_stop_lines"] = np.bincount(line_row[stop[full]], minlength=rows).astype(np.int64)
    return res


_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True


def _repeated(values: np.ndarray) -> np.ndarray:
    """True where a value occurs more than once."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = v[1:] == v[:-1]
    out = np.zeros(len(v), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def with_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs``, without its text if that is not wanted, with the columns of
    ``COUNTS`` (replacing columns of the same name)."""
    bounded_batches(docs.sparkSession)
    schema = schema_with(docs if keep_text else docs.drop(text_col),
                         *[T.StructField(c, T.LongType()) for c in COUNTS])
    kept = [f.name for f in schema.fields if f.name not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = text_counts(b.column(len(kept)))
            yield pa.RecordBatch.from_arrays(
                b.columns[:len(kept)] + [pa.array(counts[c]) for c in COUNTS], names=kept + COUNTS)

    return docs.select(*kept, F.col(text_col).alias(fresh(docs, "_text"))).mapInArrow(run, schema)


# -- rules ----------------------------------------------------------------------

def _vote(bad: Column, good: Column | None = None) -> Column:
    ok = F.when(good, F.lit(1)).otherwise(F.lit(0)) if good is not None else F.lit(0)
    return F.when(bad, F.lit(2)).otherwise(ok).cast("int")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def votes() -> dict[str, Column]:
    """Rule name -> its vote: 0 abstains, 1 good, 2 bad."""
    mean = _share("word_chars", "n_words")
    some = F.col("n_words") > 0
    return {
        "length": _vote(F.col("n_words") < 50, F.col("n_words") >= 100),
        "line_ends": _vote(some & (_share("n_stop_lines", "n_lines") < 0.25),
                           some & (_share("n_stop_lines", "n_lines") > 0.7)),
        "mean_word": _vote(~some | (mean < 2) | (mean > 12)),
        "symbols": _vote(_share("n_symbols", "n_words") > 0.15),
        "symbol_share": _vote(_share("n_symbols", "word_chars") > 0.06),
        "dup_lines": _vote(_share("n_dup_lines", "n_lines") > 0.34),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.5),
        "upper": _vote(_share("n_upper", "n_letters") > 0.3),
        "letter_words": _vote(_share("n_letter_words", "n_words") < 0.75),
    }


#: prior of a rule's votes (abstain, good, bad) in bad and in good documents, worth
#: PRIOR_DOCUMENTS documents of each class at any size of the corpus: a rule seldom
#: votes bad on a good document, which names the classes; the data outweigh it soon
PRIOR = np.array([[0.2, 0.4, 0.4], [0.2, 0.79, 0.01]])
PRIOR_DOCUMENTS = 20.0


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS
              ) -> tuple[float, np.ndarray]:
    """EM of the two-class vote model over a histogram of vote patterns
    (patterns x rules, votes 0/1/2). Returns the share of good documents and,
    per class (0 bad, 1 good) and rule, the probability of each vote. Starts
    from calling every document with a bad vote bad."""
    n, rules = patterns.shape
    if n == 0:
        return 0.5, np.repeat(PRIOR[:, None, :], rules, axis=1)
    post = np.where((patterns == 2).any(1), 0.1, 0.95)
    onehot = np.eye(3)[patterns]                              # pattern, rule, vote
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])   # class, pattern
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        probs = np.einsum("cp,prv->crv", weight, onehot)
        probs += PRIOR[:, None, :] * PRIOR_DOCUMENTS
        probs /= probs.sum(2, keepdims=True)
        new = posterior(patterns, share, probs)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(share), probs


def posterior(patterns: np.ndarray, share: float, probs: np.ndarray) -> np.ndarray:
    rules = np.arange(patterns.shape[1])
    log = [np.log(probs[c][rules, patterns]).sum(1) for c in (0, 1)]
    odds = np.clip(log[1] - log[0] + np.log(share) - np.log(1 - share), -500, 500)
    return 1 / (1 + np.exp(-odds))


def score_quality(docs: DataFrame, text_col: str = "text",
                  rules: dict[str, Column] | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text if that is not wanted) with the counts, ``p_good`` (posterior quality probability),
    ``base_failed`` (under 50 words, or more than half of the words in
    repeated 3-word windows) and ``kept`` (not base_failed, and p_good of at
    least MIN_POSTERIOR). An empty table gives an empty table."""
    rules = rules or votes()
    # one pass over the texts: the fit and the verdicts read what it wrote
    counted = written(with_counts(docs, text_col, keep_text), "quality-counts")
    keyed = counted.select(*[v.alias(f"v{i}") for i, v in enumerate(rules.values())])
    names = keyed.columns
    hist = keyed.groupBy(*names).count().collect()   # at most 3^rules rows
    patterns = np.array([[r[c] for c in names] for r in hist], dtype=np.int64).reshape(-1, len(names))
    counts = np.array([r["count"] for r in hist], dtype=float)
    share, probs = fit_votes(patterns, counts)
    odds = reduce(lambda a, b: a + b, [
        F.element_at(F.array(*[F.lit(float(np.log(probs[1, i, v]) - np.log(probs[0, i, v])))
                               for v in range(3)]), vote + 1)
        for i, vote in enumerate(rules.values())],
        F.lit(float(np.log(share) - np.log(1 - share))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (counted
            .withColumn("p_good", 1 / (1 + F.exp(-odds)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= MIN_POSTERIOR)))
