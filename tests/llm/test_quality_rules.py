import re
from collections import Counter

import numpy as np
import pytest

from sparkpanel.llm import quality_rules as qr

from llm.conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    three = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if three[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def plain_repetition(words, least):
    n, longest, covered = len(words), 0, set()
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                covered.update(range(i, i + k), range(j, j + k))
    return len(covered), longest


def rows_of(docs):
    return {r.doc_id: r for r in qr.quality_rules(docs).collect()}


def check(docs, rows):
    got = rows_of(docs)
    for d, t, *_ in rows:
        r, want = got[d], plain_counts(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, d
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    return got


def test_corpus(corpus, corpus_rows):
    got = check(corpus, corpus_rows)
    words = {d: WORD.findall(t) for d, t in corpus_rows}
    for d in [d for d in words if len(words[d]) < 400][:60]:
        covered, longest = plain_repetition(words[d], 8)
        assert (got[d].covered_words, got[d].longest_repeat) == ((covered, longest) if got[d].n_repeat_words else (0, 0))
        assert got[d].kept == (not got[d].base_failed and covered <= 0.5 * len(words[d]) and not (
            longest >= 50 and longest > 0.3 * len(words[d])))


@pytest.mark.parametrize("seed", range(30))
def test_suffix_order_against_sorting(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, rng.integers(1, 6), rng.integers(2, 60))
    order, lcp = qr.suffix_order(ids)
    assert order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:].tolist())
    for least in (1, 3, 8):
        covered, longest = plain_repetition(ids.tolist(), least)
        assert qr.repetition(ids, least) == (covered, longest)


def test_odd_rows(odd, repeated, empty):
    got = check(odd, odd_rows())
    assert not got[1].kept and got[52].kept and not got[55].kept
    assert qr.quality_rules(repeated).count() == 2 * len(odd_rows())
    assert qr.quality_rules(empty).collect() == []
    kept = qr.passing(repeated)
    assert kept.columns == repeated.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(2 * [d for d, r in got.items() if d is not None and r.kept])


def plain_excess(words):
    """The first length whose later copies hold too many characters."""
    for length, pct in ((5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)):
        seen, later = set(), set()
        for i in range(len(words) - length + 1):
            run = tuple(words[i:i + length])
            if run in seen:
                later.update(range(i, i + length))
            seen.add(run)
        if 100 * sum(len(words[i]) for i in later) > pct * sum(map(len, words)):
            return length
    return 0


def test_later_copies_reject_texts_that_pass_the_base_rules(spark, corpus, corpus_rows):
    passage, line = " ".join(f"unusual{i}" for i in range(15)), "a b c d e f g h i"
    plain = " ".join(f"w{i}" for i in range(70))
    overlapping = " ".join(["one two three four five"] * 4)
    rows = [(1, f"{passage} {plain} {passage}"), (2, f"{line} {plain} {line}"), (3, plain),
            (4, f"{plain} {overlapping}"), (5, f"{passage} {plain} {passage}".replace("u", "\u6f22"))]
    got = rows_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not any(r.base_failed for r in got.values())
    assert {d: r.kept for d, r in got.items()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert {d: r.excess_length for d, r in got.items()} == {d: plain_excess(WORD.findall(t)) for d, t in rows}
    for d, r in rows_of(corpus).items():
        words = WORD.findall(dict(corpus_rows)[d])
        assert r.excess_length == plain_excess(words)
        assert r.kept == (not r.base_failed and not r.excess_length), d


def test_passing_follows_the_verdict(spark):
    passage, plain = " ".join(f"unusual{i}" for i in range(15)), " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, f"{passage} {plain} {passage}"), (2, plain)], "doc_id long, text string")
    assert [r.doc_id for r in qr.passing(docs).collect()] == [2]
