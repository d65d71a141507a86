from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from sparkpanel.llm import packing

from llm.conftest import odd_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, pieces, tokenizer, capacity=2048):
    want = defaultdict(list)
    for d, t, *_ in rows:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for d, parts in by_doc.items():
        if len(want[d]) == 1:
            parts.sort(key=lambda p: p.start)
            ids = [x for p in parts for x in np.frombuffer(p.ids, "<u4").tolist()]
            assert ids == want[d][0]
            assert [p.start for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
            assert {p.doc_tokens for p in parts} == {len(ids)}
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        total = sum(p.length for p in parts)
        assert total <= capacity and total & (total - 1) == 0, "a full sequence or a power of two needs no padding"
    return by_sequence


def test_corpus(corpus, corpus_rows, tokenizer):
    check(corpus_rows, packing.pack(corpus, RANKS).collect(), tokenizer)


def test_odd_rows(odd, repeated, empty, tokenizer):
    check(odd_rows(), packing.pack(odd, RANKS).collect(), tokenizer)
    assert packing.pack(repeated, RANKS).agg({"length": "sum"}).first()[0] == 2 * packing.pack(odd, RANKS).agg({"length": "sum"}).first()[0]
    assert packing.pack(empty, RANKS).collect() == []


def test_windows_have_their_own_sequences(corpus, corpus_rows, tokenizer):
    check(corpus_rows, packing.pack(corpus.coalesce(1), RANKS, window=5000).collect(), tokenizer)


def test_words_are_encoded_like_whole_texts(tokenizer):
    encode = packing.Encoder(RANKS)
    for text in ["", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb c", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>", "a<|endoftext|>  \n<|endoftext", " <|endoftext|> ", 'x and, y', 'x and. y', 'x a\nb y', 'x a,\nb. y', 'x a\n\nb y', 'x \xe9, \xf1; y', "x it's, y", 'x 12, a1, y', 'x a\u2028b y', 'x ,\n. y', "x a\n's y", 'x ...\n,, y', 'x \u01c4, y', 'x a\tb\nc y', 'x , y', 'x a\n, y', "é ü 漢字", "it's we'll 12 3a", " x y", "a b c", "x ' s"]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_long_white_space(tokenizer):
    class Short(packing.Encoder):
        LONG_SPACE = 3

    encode, rng = Short(RANKS), np.random.default_rng(4)
    pool = list(" \n\t\x0b\x1c\x1f\x85\xa0\u2003\u3000 \n aZ9's\u4e2d._")
    for size in rng.integers(1, 30, 2000):
        text = "".join(rng.choice(pool, size))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    whole = packing.Encoder(RANKS)
    for text in (" " * 1_000_000 + "x", "a" + "\n" * 1_000_001, "a b" + " \t\n" * 400_000 + " b c"):
        assert whole(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_only_short_words_are_remembered():
    encode = packing.Encoder(RANKS)
    encode("a " + "b" * 101 + " " + "c" * 100)
    assert set(encode.words) == {"c" * 100}


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 4000).tolist()
    cost = defaultdict(float)
    for i, start, n, s, offset in packing.assign(lengths, 2048):
        cost[s] += n + n * n / 2048
    full = sorted(cost.values())[20:]
    assert max(full) / (sum(full) / len(full)) < 1.25


def plain_assign(lengths, capacity):
    """Every open sequence is looked at for every piece."""
    pieces, sequences = [], []
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((i, k * capacity, capacity, len(sequences), 0))
            sequences.append([0, 0.0])
    tails = sorted(((n % capacity, i) for i, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    full, rest = divmod(sum(n for n, _ in tails), capacity)
    used = {}
    sizes = [0] * len(sequences) + [capacity] * full
    cost = [0.0] * len(sizes)
    used = [0] * len(sizes)
    for n, i in tails:
        start = lengths[i] - n
        while n:
            open_ = [s for s in range(len(sizes)) if used[s] < sizes[s]]
            if not open_:
                for p in packing.powers_of_two(rest):
                    sizes.append(p)
                    cost.append(0.0)
                    used.append(0)
                continue
            s = min([s for s in open_ if sizes[s] - used[s] >= n] or open_, key=lambda s: (cost[s], s))
            take = min(n, sizes[s] - used[s])
            pieces.append((i, start, take, s, used[s]))
            used[s] += take
            cost[s] += take + take * take / capacity
            start, n = start + take, n - take
    return pieces


def test_assignment_against_all_sequences():
    rng = np.random.default_rng(9)
    for capacity in (1, 2, 7, 16, 64):
        for _ in range(60):
            lengths = rng.integers(1, 3 * capacity, int(rng.integers(0, 40))).tolist()
            assert packing.assign(lengths, capacity) == plain_assign(lengths, capacity)
    skewed = (rng.pareto(1.1, 3000) * 30 + 1).astype(int).tolist()
    assert packing.assign(skewed, 2048) == plain_assign(skewed, 2048)
