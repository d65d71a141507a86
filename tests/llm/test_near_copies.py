import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from sparkpanel.llm import near_copies

from llm.conftest import DOCUMENTS, SMALL, row_texts


def plain_sets(rows):
    out = {}
    for d, t in row_texts(rows):
        words = t.encode().lower().split()
        n = min(5, len(words))
        out[d] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()
    return out


def brute_force(rows):
    """The smallest id that each id reaches over pairs of Jaccard 0.8 or more."""
    sets = plain_sets(rows)
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


def near_rows():
    rng, rows = random.Random(3), []
    for k in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        for copy in range(1 + k % 4):
            edited = list(words)
            for i in rng.sample(range(300), rng.choice([0, 2, 5, 7, 12, 30])):
                edited[i] = f"x{rng.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(edited), "en", "s", None))
    return rows


def test_pipeline_drops_near_copies_that_differ_by_more_than_three_bits(spark):
    rows = near_rows()
    group = brute_force([r[:2] for r in rows])
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCUMENTS), SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, g in group.items() if d == g)


def test_groups(spark, corpus, corpus_rows, odd, empty):
    for docs, rows in ((corpus, corpus_rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        for block in (near_copies.BLOCK, 2):
            found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, block=block).collect()}
            assert {-(1 << 63) if d is None else d: -(1 << 63) if c is None else c
                    for d, c in found.items()} == brute_force(rows)
    assert near_copies.near_copies(empty).collect() == []


def flipped(rng, prints, bits):
    out = np.unpackbits(prints.view(np.uint8), bitorder="little")
    out[bits] ^= 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def test_covering_masks_meet_within_their_radius():
    """Up to 4 * PARTS - 1 differing bits always leave a part within three bits, whose masks cover them."""
    rng, ones = np.random.default_rng(7), np.ones(1, np.int64)
    for _ in range(300):
        mine = rng.integers(0, 1 << 64, near_copies.WORDS, np.uint64, endpoint=False)
        bits = rng.choice(near_copies.PARTS * near_copies.WIDTH, 4 * near_copies.PARTS - 1, replace=False)
        a, b = (near_copies.buckets(x[None], ones) for x in (mine, flipped(rng, mine, bits)))
        assert a.shape == (1, 15 * near_copies.PARTS) and len(set(a[0].tolist())) == a.size
        assert (a == b).any()


def test_sets_at_the_limit_meet():
    rng = np.random.default_rng(8)
    ones = np.ones(1, np.int64)
    for mine, other, both in ((9, 9, 8), (90, 90, 80), (500, 400, 400)):
        for _ in range(300):
            h = rng.integers(0, 1 << 64, mine + other - both, np.uint64, endpoint=False)
            a, b = near_copies.fingerprint(h[:mine]), near_copies.fingerprint(h[mine - both:])
            assert (near_copies.buckets(a[None], ones) == near_copies.buckets(b[None], ones)).any()
            assert np.bitwise_count(a[-3:] ^ b[-3:]).sum() <= near_copies.farthest(0.8)


def test_connected_rows_against_all_pairs():
    for seed in range(100):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 120))
        place = np.sort(rng.integers(0, 200, n))
        checks = rng.integers(0, 1 << 63, (4, 3)).astype(np.uint64)[rng.integers(0, 4, n)] ^ (
            np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64))
        window, most, group = int(rng.integers(0, 40)), int(rng.integers(0, 7)), list(range(n))
        for i, j in combinations(range(n), 2):
            if place[j] - place[i] <= window and np.bitwise_count(checks[i] ^ checks[j]).sum() <= most and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
        assert near_copies.connected(place, checks, window, most).tolist() == group
