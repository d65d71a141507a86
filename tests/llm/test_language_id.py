import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import language_id as li

from llm.conftest import odd_rows


def plain_bits(train, text, order):
    """Method C with exclusion, byte by byte."""
    counts = defaultdict(Counter)
    for t in train:
        padded = b"\0" * order + t.encode()
        for i in range(order, len(padded)):
            for o in range(order + 1):
                counts[padded[i - o:i]][padded[i]] += 1
    bits, padded = 0.0, b"\0" * order + text.encode()
    for i in range(order, len(padded)):
        excluded = set()
        for o in range(order, -1, -1):
            seen = counts.get(padded[i - o:i])
            if seen is None:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            weight = sum(left.values()) + len(left)
            if padded[i] in left:
                bits += math.log2(weight / left[padded[i]])
                break
            if left:
                bits += math.log2(weight / len(left))
            excluded = set(seen)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


def tree(train, order):
    codes, n = np.unique(np.concatenate([li.gram_codes(t.encode(), order) for t in train]), return_counts=True)
    return li.ContextTree(codes, n.astype(float), order)


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_code_lengths(order, corpus_rows):
    train = [t[:400] for _, t in corpus_rows[:12]] + ["abracadabra", "aaaa"]
    model = li.Model(["x"], [tree(train, order)], order)
    texts = [t[:300] for _, t in corpus_rows[10:20]] + ["abra", "zzz", "", "漢字", "\0\0a"]
    want = [plain_bits(train, t, order) for t in texts]
    for chunk in (1 << 20, 7, 64):
        assert np.allclose(model.bits(texts, chunk)[:, 0], want)


def test_grams_that_share_a_slot(corpus_rows):
    """256 slots for some thousand grams: kept costs are replaced all the time and lengths stay exact."""
    parts = [[t[:3000] for _, t in corpus_rows[:6]], [t[:3000] for _, t in corpus_rows[6:12]]]
    model = li.Model(["x", "y"], [tree(p, 4) for p in parts], 4)
    texts = [t[:2000] for _, t in corpus_rows[4:16] if t]
    small = li.Scorer(model, 2)
    assert len(small.grams) == 256
    want = np.array([[plain_bits(p, t, 4) for p in parts] for t in texts])
    for chunk in (100, 1 << 16, 100):
        assert np.allclose(small.bits(texts, chunk), want)


def test_lengths_make_a_distribution(corpus_rows):
    """All 256 bytes after a context have chances that sum to 1."""
    t = tree([x[:300] for _, x in corpus_rows[:5]], 3)
    for context in (b"the", b"\0\0\0", b"zzz", b" th"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert abs(np.exp2(-t.bits(codes)).sum() - 1) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang and len(r.text) > 20]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_letters():
    assert all(map(li.has_letter, ["a", "1\u4e2d", "\xaa", "\u01c5 2"]))
    assert not any(map(li.has_letter, ["", "12 _", "\xb2\xbd", "\u2167", "\u0301", "\U0001f600"]))


def test_odd_rows(odd, repeated, empty):
    got = {r.doc_id: r for r in li.language_id(odd).collect()}
    assert len(got) == len(odd_rows())
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0) and got[4].lang_pred == got[7].lang_pred == "und"
    assert {r.lang_pred for d, r in got.items() if d not in (1, 4, 7)} == {"en"}, "a null id is not learned from"
    assert li.language_id(repeated).count() == 2 * len(odd_rows())
    assert li.language_id(empty).collect() == []
    assert {r.lang_pred for r in li.predict(odd, None).collect()} == {"und"}


def test_a_language_of_one_long_text_keeps_its_place(spark):
    """Pieces are drawn, so neither a few large texts nor many small ones can leave a language without a tree."""
    long = " ".join(f"the house number {i} stands on the street of the town" for i in range(60_000))
    rows = [(1, long, "en")] + [(i + 2, f"la maison du village {i} est dans la rue", "fr") for i in range(37)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for start in ("a ", "b ", "c "):
        model = li.fit(docs.withColumn("text", F.concat(F.lit(start), "text")), sample_bytes=1 << 15)
        assert model.languages == ["en", "fr"]
    whole = li.fit(docs.filter("lang = 'fr'"), sample_bytes=1 << 20)
    assert whole.trees[0].levels[0][1].sum() == sum(len(t.encode()) for _, t, lang in rows if lang == "fr")
    drawn = li.fit(docs.filter("lang = 'en'"), sample_bytes=1 << 16).trees[0].levels[0][1].sum()
    assert 0.6 < drawn / (1 << 16) < 1.5
