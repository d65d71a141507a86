import hashlib

from pyspark.sql import functions as F

from sparkpanel.llm import order_minhash as om

from llm.conftest import odd_rows, row_texts


def edited(rows):
    rows = row_texts(rows)
    out = {}
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        out[d] = (t[:len(t) - half] + after[1][:half], after[0])
    return out


def plain_signature(spark, texts):
    """k-mers, their numbers, slots and tuples step by step in Python; only the hash function is Spark's."""
    import re

    def h(kind, rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + kind)
        return [x[0] for x in df.orderBy("i").select(F.xxhash64(*df.columns[1:])).collect()]

    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t) if w] for t in texts]
    ids = iter(h("w string", [(w,) for ws in words for w in ws]))
    hashed = [[next(ids) for _ in ws] for ws in words]
    grams = [(k, i, hs) for k, hs in enumerate(hashed) for i in range(len(hs) - 2) if len(hs) > 3]
    values = h("a long, b long, c long", [hs[i:i + 3] for _, i, hs in grams])
    whole = [(k, hs) for k, hs in enumerate(hashed) if 0 < len(hs) <= 3]
    per = {k: [] for k in range(len(texts))}
    for (k, _, _), v in zip(grams, values):
        per[k].append(v)
    for k, hs in whole:
        per[k].append(spark.createDataFrame([(hs,)], "a array<bigint>").select(F.xxhash64("a")).first()[0])
    flat = []
    for k, vs in per.items():
        seen = {}
        for i, v in enumerate(vs):
            flat.append((k, i, v, seen.setdefault(v, 0)))
            seen[v] += 1
    marks = h("a long, n int", [(v, n) for _, _, v, n in flat])
    slots = {}
    for (k, i, _, _), m in zip(flat, marks):
        m = (m & (1 << 63) - 1) >> om.PLACE
        slots.setdefault((k, m >> 63 - om.PLACE - 5), []).append((m, i))
    keys = list(slots)
    tuples = [[m for m, i in sorted(sorted(slots[key])[:om.KEEP], key=lambda x: x[1])] for key in keys]
    hashes = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(tuples)], "i long, t array<bigint>").orderBy(
        "i").select(F.xxhash64("t")).collect()]
    out = {k: [None] * om.SLOTS for k in range(len(texts))}
    for (k, slot), v in zip(keys, hashes):
        out[k][slot] = v
    return out


def by_id(docs):
    return {-(1 << 63) if r.doc_id is None else r.doc_id: r for r in om.order_minhash(docs).collect()}


def check(spark, docs, rows):
    got, texts, want = by_id(docs), dict(row_texts(rows)), edited(rows)
    assert set(got) == set(texts)
    keys = list(texts)
    plain = plain_signature(spark, [texts[k] for k in keys])
    for i, k in enumerate(keys):
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(texts[k]), hashlib.sha256(want[k][0].encode()).hexdigest())
        assert r.signature == plain[i], k
        other = got[want[k][1]].signature
        used = [(a, b) for a, b in zip(r.signature, other) if a is not None or b is not None]
        assert r.near_next == (sum(a == b for a, b in used) / len(used) if used else 1.0)
    return got


def test_corpus(spark, corpus, corpus_rows):
    got = check(spark, corpus, corpus_rows)
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 4 * sum(r.near_next for r in long) / len(long)


def test_odd_rows(spark, odd, repeated, empty):
    got = check(spark, odd, odd_rows())
    assert got[16].signature == got[19].signature and got[1].near_next == 1.0
    again = by_id(repeated)
    assert {k: (r.n_chars, r.edited_sha256, r.signature) for k, r in again.items()} == {
        k: (r.n_chars, r.edited_sha256, r.signature) for k, r in got.items()}
    assert by_id(empty) == {}


def test_one_document(spark):
    got = by_id(spark.createDataFrame([(5, "alone in the world")], "doc_id long, text string"))
    assert got[5].near_next == 1.0


def test_order_counts(spark):
    """The same k-mers in another order give another signature."""
    parts = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(8)]
    docs = spark.createDataFrame([(0, " ".join(parts)), (1, " ".join(parts[::-1]))], "doc_id long, text string")
    got = by_id(docs)
    assert 0.02 < got[0].near_next < 0.8


def test_native(corpus):
    plan = om.order_minhash(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
