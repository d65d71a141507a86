import re
from itertools import combinations

import xxhash

from sparkpanel.llm import simhash

from llm.conftest import odd_rows, row_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_force(rows):
    prints = {d: plain_fingerprint(t) for d, t in row_texts(rows)}
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (prints[d], root(d)) for d in prints}


def result(docs, **options):
    low = -(1 << 63)
    return {low if r.doc_id is None else r.doc_id: (r.fp % (1 << 64), low if r.component_id is None else r.component_id)
            for r in simhash.simhash_groups(docs, **options).collect()}


def test_masks_cover_every_triple():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for bits in combinations(range(64), 3):
        assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_odd_rows(odd):
    assert result(odd) == brute_force(odd_rows())


def test_corpus(corpus, corpus_rows):
    assert result(corpus) == brute_force(corpus_rows)


def test_chain_over_many_blocks(spark):
    """Fingerprints that differ by single bits form one component, also when its buckets are dealt over block pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 12, 300), rng.integers(0, 1 << 62, 50)]).astype(np.uint64))
    pairs = {(i, j) for i, j in combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    links = list(simhash.spanning_links(fps, 3))
    assert set(map(tuple, links)) <= {(i, j) for i in range(len(fps)) for j in range(len(fps))}
    parent = list(range(len(fps)))

    def root(i, p):
        while p[i] != i:
            i = p[i]
        return i

    mine = list(range(len(fps)))
    for p, edges in ((parent, pairs), (mine, links)):
        for i, j in edges:
            i, j = sorted((root(int(i), p), root(int(j), p)))
            p[j] = i
    assert [root(i, parent) for i in range(len(fps))] == [root(i, mine) for i in range(len(fps))]


def test_small_blocks(corpus, odd, corpus_rows):
    assert result(corpus, block=2) == brute_force(corpus_rows)


def test_one_stays(corpus, corpus_rows):
    groups = brute_force(corpus_rows)
    kept = simhash.keep_one_per_group(corpus)
    assert kept.columns == corpus.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {root for _, root in groups.values()}


def test_repeated_rows_and_empty_table(odd, repeated, empty):
    assert result(repeated) == result(odd)
    assert result(empty) == {}
    assert simhash.keep_one_per_group(repeated).columns == repeated.columns
