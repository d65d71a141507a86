import hashlib

import pytest

from sparkpanel.llm.suffix_dedup import suffix_dedup

from llm.conftest import odd_rows, row_texts


def brute_force(rows):
    first, out = {}, {}
    for d, t in row_texts(rows):
        b = t.encode()
        for s in range(len(b) - 99):
            first.setdefault(b[s:s + 100], (d, s))
    for d, t in row_texts(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s:s + 100]] < (d, s):
                gone[s:s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(docs, *sizes):
    return {-(1 << 63) if r.doc_id is None else r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
            for r in suffix_dedup(docs, *sizes).collect()}


def test_odd_rows(odd):
    assert result(odd) == brute_force(odd_rows())


def test_corpus(corpus, corpus_rows):
    assert result(corpus) == brute_force(corpus_rows)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_slices_and_blocks(corpus, corpus_rows, small_batches):
    """Buckets that go over slices, stretches that end at block borders."""
    assert result(corpus, 333, 20, 3000) == brute_force(corpus_rows)


@pytest.mark.parametrize("length", [80, 100, 130, 175, 260])
def test_passage_in_many_surroundings(spark, small_batches, length):
    """One bucket with a stretch of its own in each document, over many slices, and neighbours that share a part."""
    import random

    rng = random.Random(length)
    passage = "".join(rng.choices("abcdefgh ", k=length))
    sides = ["".join(rng.choices("ijklm ", k=120)) for _ in range(6)]
    rows = [(i, ("".join(rng.choices("nopq", k=90)) if i % 3 else "") + rng.choice(sides)[i % 60:] + passage
             + rng.choice(sides)[:120 - i % 50] + "".join(rng.choices("rst", k=i))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "x" + "ab" * 200 + passage), (102, "a" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs, 1 << 18, 30, 2000) == brute_force(rows)


def test_repeated_rows_and_extra_columns(odd, repeated):
    """Each row counts, in the order of its key; the later of two equal rows loses all that has 100 bytes."""
    from sparkpanel.llm.common import Keyed

    rows = [(r.doc_id, r.text) for r in sorted(Keyed(repeated).table.collect(), key=lambda r: r.row_key)]
    want = brute_force([(place, t) for place, (_, t) in enumerate(rows)])
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup(repeated).collect()]
    assert sorted(got, key=str) == sorted(((rows[k][0], *v) for k, v in want.items()), key=str)


def test_empty(empty):
    assert result(empty) == {}


@pytest.mark.parametrize("texts", [["x" * 100, "y" + "x" * 100], ["x" * 99, "x" * 99], ["x" * 100, "x" * 101]])
def test_short(spark, texts):
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute_force(rows)
