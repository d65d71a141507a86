"""Quality rules: counts of words, symbols and repeated lines, and repetition found with a suffix array.

Per document, prefix doubling sorts the suffixes of the word sequence.  The longest common prefix of two
neighbours in that order is a maximal repeated run of words; the union of both places over all neighbours is what
repetition covers.  A document fails if that union or the longest repeat takes too large a part of it, or if the later
copies of runs of some length hold too many of its characters.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WHITE, texts_of

SYMBOLS = "#*$%&|<>"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "covered_words long, longest_repeat long, excess_length long, base_failed boolean, kept boolean")


@dataclass(frozen=True)
class Limits:
    """min_words, max_repeat_pct: the base rules. A repeat counts from repeat_words on; documents go whose repeats cover
    over max_covered of their words, or whose longest repeat is over max_longest of them and longest_words long, or whose
    later copies of runs of some length in max_later_pct hold more than that percentage of the characters in words (the
    graded limits published for web text).

    A word that a run of three or more covers lies in a repeated 3-word window, so max_covered acts only below
    max_repeat_pct; the later copies are counted by characters and at lower limits, and act beside the base rules.
    """

    min_words: int = 50
    max_repeat_pct: int = 50
    repeat_words: int = 8
    max_covered: float = 0.5
    max_longest: float = 0.3
    longest_words: int = 50
    max_later_pct: tuple[tuple[int, int], ...] = ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10))


def word_ids(words: list) -> np.ndarray:
    """Words numbered by first appearance."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b); b may hold -1."""
    return np.unique(a * (b.max(initial=0) + 2) + b + 1, return_inverse=True)[1]


def repeated_trigram_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    three = pair_ids(pair_ids(ids[:-2], ids[1:-1]), ids[2:]) if ids.max() >= 1 << 20 else (
        ids[:-2] << 40 | ids[1:-1] << 20 | ids[2:])
    ordered = np.sort(three)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    window = np.isin(three, again)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= window
    return int(covered.sum())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes of neighbours (lcp[i]: of entries i and i + 1), by prefix doubling."""
    n, step = len(ids), 1
    levels = [np.unique(ids, return_inverse=True)[1]]
    while levels[-1].max() + 1 < n:
        rank = levels[-1]
        levels.append(pair_ids(rank, np.concatenate([rank[step:], np.full(min(step, n), -1)])))
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[level], -1)  # past the end
        inside = (left < n) & (right < n)
        # a level's rank covers the end of the text, so equal ranks of two places mean 2^level equal words
        same = inside & (rank[np.minimum(left, n)] == rank[np.minimum(right, n)])
        lcp[same] += 1 << level
        left[same] += 1 << level
        right[same] += 1 << level
    return order, lcp


def repetition(ids: np.ndarray, at_least: int) -> tuple[int, int]:
    """(words that repeats of ``at_least`` words cover, words of the longest repeat)."""
    return covered_by(*suffix_order(ids), at_least) if len(ids) > 1 else (0, 0)


def covered_by(order: np.ndarray, lcp: np.ndarray, at_least: int) -> tuple[int, int]:
    long = lcp >= at_least
    change = np.zeros(len(order) + 1, np.int64)
    for at in (order[:-1][long], order[1:][long]):
        np.add.at(change, at, 1)
        np.add.at(change, at + lcp[long], -1)
    return int((np.cumsum(change)[:-1] > 0).sum()), int(lcp.max())


def later_copies(order: np.ndarray, lcp: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a run of ``length`` words that also starts earlier."""
    first = np.flatnonzero(np.r_[True, lcp < length])  # suffixes that share their first words are neighbours
    earliest = np.repeat(np.minimum.reduceat(order, first), np.diff(np.r_[first, len(order)]))
    starts = order[order > earliest]
    change = np.zeros(len(order) + 1, np.int64)
    change[starts] += 1
    change[starts + length] -= 1
    return np.cumsum(change)[:-1] > 0


def excess_length(words: list[bytes], order: np.ndarray, lcp: np.ndarray, limits: Limits) -> int:
    """The first length whose later copies hold more characters than its limit allows, 0 if there is none."""
    sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
    for length, pct in limits.max_later_pct:
        if 100 * sizes[later_copies(order, lcp, length)].sum() > pct * sizes.sum():
            return length
    return 0


def judge(text: str, limits: Limits) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    n, ids = len(words), word_ids(words)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(WHITE):
            seen.add(line)
    repeat_words = repeated_trigram_words(ids)
    covered = longest = excess = 0
    # without a repeated 3-word window no longer repeat exists
    if n > 1 and (repeat_words or min([limits.repeat_words, *(k for k, _ in limits.max_later_pct)]) < 3):
        suffixes = suffix_order(ids)
        covered, longest = covered_by(*suffixes, limits.repeat_words)
        excess = excess_length(words, *suffixes, limits)
    failed = n < limits.min_words or 100 * repeat_words > limits.max_repeat_pct * n
    too_much = excess > 0 or covered > limits.max_covered * n or (
        longest >= limits.longest_words and longest > limits.max_longest * n)
    return (n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup_lines, repeat_words,
            covered, longest, excess, failed, not (failed or too_much))


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per input row with its counts and verdict.

    A null or empty text has no words and fails; ids may be null or repeat, each row is judged on its own; further
    columns are not read; an empty table gives no row.  ``longest_repeat`` is 0 below three words, ``excess_length`` the
    shortest run length whose later copies are over their limit, 0 if none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*(judge(t, limits) for t in texts_of(batch)))
                kinds = [pa.int64()] * 8 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "covered_words", "longest_repeat", "excess_length", "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def passing(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` whose text passes; columns stay as they are.  Null texts go."""
    @F.pandas_udf("boolean")
    def keeps(text: pd.Series) -> pd.Series:
        return pd.Series([judge(t or "", limits)[-1] for t in text], dtype=bool)

    return docs.filter(keeps("text"))
