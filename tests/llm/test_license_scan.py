import random
from itertools import combinations

import pytest

from sparkpanel.llm import license_scan as ls

from llm.conftest import odd_rows


@pytest.mark.parametrize("seed", range(40))
def test_increasing_is_longest(seed):
    rng = random.Random(seed)
    values = rng.sample(range(50), rng.randint(0, 9))
    got = [values[i] for i in ls.increasing(values)]
    assert got == sorted(set(got))
    best = max((len(c) for n in range(len(values) + 1) for c in combinations(values, n) if list(c) == sorted(set(c))), default=0)
    assert len(got) == best


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_a_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 30))] for _ in range(2))
    pairs = ls.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert ls.align(a, a) == [(i, i) for i in range(len(a))]


NOTICE = ls.NOTICES["Apache-2.0"][1]


@pytest.mark.parametrize("name", ls.NOTICES)
def test_notices_are_found(name):
    known = ls.templates()
    for notice in ls.NOTICES[name]:
        text = "some words before\n" + notice.replace(" ", "\n * ", 4) + "\n and after that nothing"
        assert [h[0] for h in ls.scan(text, known, 0.8)] == [name]


def test_changes_and_repeats():
    known = ls.templates()
    words = NOTICE.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 11)
    hits = ls.scan(f"{edited} filler text {' x' * 300} {NOTICE}", known, 0.8)
    assert [h[0] for h in hits] == ["Apache-2.0"] * 2 and 0.8 <= hits[0][1] < 1 == hits[1][1]
    assert ls.scan(" ".join(words[:len(words) // 2][10:]), known, 0.8) == []
    text = "x " * 9 + NOTICE
    (_, _, start, end), = ls.scan(text, known, 0.8)
    assert text[start:end].startswith("Licensed under") and text[start:end].endswith("implied")


def test_rows(spark, corpus, odd, repeated, empty):
    got = {r.doc_id: r for r in ls.license_scan(corpus).collect()}
    for r in corpus.collect():
        for name in ls.NOTICES:
            if name != "reserved" and ls.NOTICES[name][0] in r.text:
                assert name in [h.license for h in got[r.doc_id].found]
        if not got[r.doc_id].found:
            assert got[r.doc_id].license is None and "icense" not in r.text and "ll rights reserved" not in r.text
    assert {r.license for r in ls.license_scan(odd).collect()} == {None}
    assert ls.license_scan(repeated).count() == 2 * len(odd_rows())
    assert ls.license_scan(empty).collect() == []


@pytest.mark.parametrize("name", ls.NOTICES)
@pytest.mark.parametrize("gap", ["", "baz", "baz " * 12])
def test_copies_close_together(name, gap):
    for notice in ls.NOTICES[name]:
        text = f"foo bar {notice} {gap} {notice} {gap} {notice} qux"
        hits = ls.scan(text, ls.templates(), 0.8)
        assert [(h[0], h[1]) for h in hits] == [(name, 1.0)] * 3, (notice, gap, hits)


def test_notices_without_their_rarest_words():
    known = ls.templates()
    for t in known:
        if len(t.words) < 20:
            continue
        lost = sorted(t.keys, key=lambda w: (-len(w), w))[:3]
        words = [w for w in t.words if w not in lost]
        if len(words) >= 0.8 * len(t.words):
            assert t.license in [h[0] for h in ls.scan("foo " + " ".join(words) + " bar", known, 0.8)]
    long = [f"w{i}" for i in range(200)]
    known = ls.templates({"long": [" ".join(long)]})
    rare = set(sorted(long, key=lambda w: (-len(w), w))[:3])
    assert [h[0] for h in ls.scan("a " + " ".join(w for w in long if w not in rare) + " b", known, 0.8)] == ["long"]
