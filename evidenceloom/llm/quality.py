"""Quality rules under weak supervision.

Each rule looks at one property of a text and votes for good (1), votes for bad (-1) or abstains (0).
Expectation-maximisation over all documents estimates each rule's accuracy on either class and the
share of good documents; a document is kept if its posterior probability of being good is at least
``keep``. What the estimation needs are the counts of vote patterns, at most 3 ** len(RULES) numbers
however large the table; all documents count.

Words are ``[^\\x20\\x09-\\x0D]+``. Two hard limits stand before the vote (``base_failed``): fewer than 50
words, or over half of the words in three-word windows that occur more than once in the text.

Defined results: null and empty texts have no words and fail; repeated rows get equal results; an
empty table gives an empty one; further columns pass through (clashing names get an underscore).
Lines and windows are compared within one text by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as X
from .columns import free

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_ended", "n_upper", "n_letters", "n_shouts", "n_bars", "n_plain")
_SYMBOL, _UPPER = X._table(b"#*$%&|<>"), X._table(bytes(range(0x41, 0x5B)))
_LETTER = X._table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_WORDY = _LETTER | X._table(bytes(range(0x80, 0x100)))
_END = X._table(b".?!:;,\"')")
_SHOUT, _BAR = X._table(b"!"), X._table(b"|{}<>[]=\\^~")


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE of each text."""
    buf, offs = X.flat(column)
    out = {k: np.zeros(len(column), np.int64) for k in (*COUNTS, *MORE)}
    for a, b in X.pieces(offs):
        raw, o, n = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], b - a
        starts, ends, owner = X.spans(raw, o, X.NOT_SPACE)
        sums = X.prefix_sums(raw)
        out["n_words"][a:b] = np.bincount(owner, minlength=n)
        out["word_chars"][a:b] = X.per_value(X.NOT_SPACE[raw] & ((raw & 0xC0) != 0x80), o)
        for k, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_shouts", _SHOUT), ("n_bars", _BAR)):
            out[k][a:b] = X.per_value(table[raw], o)
        wordy, odd = (np.concatenate(([0], np.cumsum(t[raw]))) for t in (_WORDY, _SYMBOL))
        other = ends - starts - (wordy[ends] - wordy[starts])
        plain = (wordy[ends] > wordy[starts]) & (other <= 2) & (odd[ends] == odd[starts])
        out["n_plain"][a:b] = np.bincount(owner[plain], minlength=n)
        first, last, of = X.spans(raw, o, X.NOT_NEWLINE)
        worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)  # a word starts in the line
        first, last, of = first[worded], last[worded], of[worded]
        lines = np.bincount(of, minlength=n)
        out["n_lines"][a:b] = lines
        stop = ends[np.searchsorted(starts, last) - 1] if len(last) else last  # of each line's last word
        out["n_ended"][a:b] = np.bincount(of[_END[raw[stop - 1]]], minlength=n)
        out["n_dup_lines"][a:b] = lines - _distinct(X.span_hashes(sums, first, last), of, n)
        h, at = X.window_hashes(X.span_hashes(sums, starts, ends), owner, 3)
        if len(h):
            _, inverse, counts = np.unique(_with(h, owner[at]), return_inverse=True, return_counts=True)
            inside = X.covered(at[counts[inverse] > 1], 3, len(starts))
            out["n_repeat_words"][a:b] = np.bincount(owner[inside], minlength=n)
    return out


def _with(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return X.mix(h + owner.astype(X.U) * X.U(0xA0761D6478BD642F))


def _distinct(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[np.unique(_with(h, owner), return_index=True)[1]], minlength=n)


def _share(m: dict[str, np.ndarray], a: str, b: str) -> np.ndarray:
    return m[a] / np.maximum(m[b], 1)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0))


#: Each rule's vote from the measures. Most know one fault and abstain where they don't see it.
RULES = {
    "symbols": lambda m: np.where(_share(m, "n_symbols", "n_words") > 0.25, -1, 0),
    "bars": lambda m: np.where(_share(m, "n_bars", "n_words") > 0.15, -1, 0),
    "capitals": lambda m: np.where(_share(m, "n_upper", "n_letters") > 0.4, -1, 0),
    "shouting": lambda m: np.where(_share(m, "n_shouts", "n_words") > 0.2, -1, 0),
    "same_lines": lambda m: np.where((_share(m, "n_dup_lines", "n_lines") > 0.4) & (m["n_dup_lines"] >= 4), -1, 0),
    "same_words": lambda m: np.where(_share(m, "n_repeat_words", "n_words") > 0.4, -1, 0),
    "plain_words": lambda m: _vote((x := _share(m, "n_plain", "n_words")) < 0.75, x > 0.9),
    "ended_lines": lambda m: np.where(_share(m, "n_ended", "n_lines") > 0.9, 1, 0),
    "word_length": lambda m: _vote(((x := _share(m, "word_chars", "n_words")) < 2.5) | (x > 14), (x > 3.5) & (x < 7.5)),
}


def patterns(m: dict[str, np.ndarray]) -> np.ndarray:
    """The votes on each text as the base-3 digits of one number (0 bad, 1 abstains, 2 good)."""
    return sum((rule(m) + 1).astype(np.int64) * 3**i for i, rule in enumerate(RULES.values()))


def votes(pattern: int) -> tuple[int, ...]:
    return tuple(pattern // 3**i % 3 - 1 for i in range(len(RULES)))


def failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], float, np.ndarray]:
    """Posterior probability of good for each vote pattern, the share of good, and each rule's accuracy on (bad, good).

    The two classes keep their meaning as accuracies stay above one half; each estimate has a few
    votes of prior weight, so that a rule that seldom votes moves little.
    """
    seen = np.array(sorted(counts), dtype=np.int8).reshape(len(counts), len(RULES))
    weight = np.array([counts[tuple(p)] for p in seen.tolist()], dtype=float)
    accuracy, share = np.full((2, len(RULES)), 0.8), 0.8
    good = np.full(len(seen), share)
    says_good, says_bad = seen == 1, seen == -1
    for _ in range(rounds if len(seen) else 0):
        as_good = says_good @ np.log(accuracy[1]) + says_bad @ np.log(1 - accuracy[1]) + np.log(share)
        as_bad = says_bad @ np.log(accuracy[0]) + says_good @ np.log(1 - accuracy[0]) + np.log(1 - share)
        good = 1 / (1 + np.exp(np.clip(as_bad - as_good, -700, 700)))
        wg, wb = weight * good, weight * (1 - good)
        accuracy[1] = (wg @ says_good + 8) / (wg @ (says_good | says_bad) + 10)
        accuracy[0] = (wb @ says_bad + 8) / (wb @ (says_good | says_bad) + 10)
        accuracy = accuracy.clip(0.55, 0.995)
        share = float(np.clip((wg.sum() + 8) / (weight.sum() + 10), 0.05, 0.95))
    return dict(zip(map(tuple, seen.tolist()), good.tolist(), strict=True)), share, accuracy


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[tuple[int, ...], int]:
    """How often each vote pattern occurs among the documents within the hard limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column(0))
            p, n = np.unique(patterns(m)[~failed(m)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n.astype(np.int64))], names=["p", "n"])

    counts = docs.select(F.col(f"`{text}`")).mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return {votes(r["p"]): r["n"] for r in counts.collect()}


def judge(docs: DataFrame, text: str = "text", keep: float = 0.5) -> DataFrame:
    """docs with COUNTS, base_failed, posterior and kept; the texts are read once for the counts and once for the verdict."""
    posterior, _, _ = estimate(pattern_counts(docs, text))
    new = [free(docs, n) for n in (*COUNTS, "base_failed", "posterior", "kept")]
    kinds = [*[T.LongType()] * len(COUNTS), T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema, *map(T.StructField, new, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column(batch.schema.get_field_index(text)))
            bad = failed(m)
            seen, which = np.unique(patterns(m), return_inverse=True)
            good = np.array([posterior.get(votes(p), 0.0) for p in seen.tolist()], dtype=float)[which]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(m[k]) for k in COUNTS), pa.array(bad), pa.array(good), pa.array(~bad & (good >= keep))], names=schema.names)

    return docs.mapInArrow(run, schema)
