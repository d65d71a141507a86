import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparkpanel.llm import spelling
from sparkpanel.llm.queries import QUERIES

from llm.conftest import DOCUMENTS, SMALL

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows):
    words = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_force(rows):
    words = counted(rows)
    near = {w: [] for w in words}
    listed = sorted(words)
    cuts = {}
    for w in listed:  # words one apart share a word or a word with a gap
        for i in range(len(w) + 1):
            for k in {w, w[:i] + w[i + 1:], w[:i] + "?" + w[i + 1:]}:
                cuts.setdefault(k, set()).add(w)
    for group in cuts.values():
        for a in group:
            near[a] += [b for b in group if one_apart(a, b)]
    out = {}
    for w in listed:
        others = set(near[w])
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * words[w] else None
        out[w] = (form, words[w], len(others), words[form] if form else None)
    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w
    return {w: (form, root(w), n, k, fn) for w, (form, n, k, fn) in out.items()}


def as_dict(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query(spark, corpus_rows):
    got = as_dict(QUERIES["op13_spelling"](spark, SMALL))
    assert got == brute_force(corpus_rows) and len(got) > 100


def made(seed=2, size=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé÷") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words += [w[:i] + rng.choice("abcß") + w[i + rng.randint(0, 1):] for w in words for i in range(0, len(w), 2)]
    words += [w[:i] + w[i + 1:] for w in words for i in (0, 3, len(w) - 1)]
    weight = [rng.random() ** 8 * 200 + 1 for _ in words]
    return [(i, rng.choice([" ", "-", " ", "漢"]).join(w.upper() if rng.random() < .1 else w for w in rng.choices(words, weight, k=120))) for i in range(size)]


def test_dense_vocabulary_in_blocks(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert sum(v[3] for v in want.values()) > 500 and sum(v[0] is not None for v in want.values()) > 50
    assert sum(v[0] is not None and v[0] != v[1] for v in want.values()) > 0
    for block in (4096, 3):
        assert as_dict(spelling.spelling_variants(docs, block=block)) == want


def test_index_against_definition():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    index = spelling.PositionIndex(words)
    for w in words + ["", "c", "abababab"]:
        replaced, inserted = index.near(w)
        assert [words[i] for i in spelling.bits_of(replaced)] == [x for x in words if len(x) == len(w) and one_apart(w, x)]
        assert [words[i] for i in spelling.bits_of(inserted)] == [x for x in words if len(x) == len(w) + 1 and one_apart(w, x)]


def test_odd_tables(spark, odd, repeated, empty):
    for docs in (odd, repeated):
        assert as_dict(spelling.spelling_variants(docs)) == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    long = spark.createDataFrame([(1, "Wordlike wordlike, wordlika " * 300_000, None, None, None)] * 2, DOCUMENTS)
    assert as_dict(spelling.spelling_variants(long))["wordlike"][2] == 1_200_000
    assert spelling.spelling_variants(empty).count() == 0
    assert list(spelling.runs("Ab, çD×é漢x", 2)) == [[b"ab"], [b"\xe7d\xd7\xe9"], [b"x"]] or [w for p in spelling.runs("Ab, çD×é漢x", 2) for w in p] == [b"ab", b"\xe7d\xd7\xe9", b"x"]
    assert spelling.near_words(spark.createDataFrame([("abcdef", 5)], "word string, n long")).filter(F.lit(True)).count() == 0
