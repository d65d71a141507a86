import heapq

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sparkpanel.llm import merge_dropout as md

from llm.conftest import odd_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world", "  two  blanks ", "tabs\tand\nlines\n\n x", "漢字 é ▁ under▁score", "a", " ", "   ", "zzzzqqqq" * 30, "🙂🙃 emoji", "été à l'école"]


@pytest.fixture(scope="module")
def merges():
    return md.Merges(MODEL)


def agenda(merges, word, variant, seed, dropout):
    """One word, one merge at a time, from a heap of candidate pairs."""
    left_of = {i: i - 1 for i in range(len(word))}
    right_of = {i: i + 1 for i in range(len(word))}
    piece = dict(enumerate(word))
    limit, heap = md.threshold(dropout), []

    def offer(i):
        j = right_of.get(i, len(word))
        if i < 0 or j >= len(word):
            return
        joined, a, b = piece[i] + piece[j], merges.ids.get(piece[i]), merges.ids.get(piece[j])
        if a is None or b is None or joined not in merges.ids:
            return
        if dropout and md.keyed_hash(seed, *(np.array([x]) for x in (variant, a, b, i)))[0] < limit:
            return
        heapq.heappush(heap, (merges.rank[merges.ids[joined]], i, joined))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if i not in piece or right_of[i] >= len(word) or piece[i] + piece[right_of[i]] != joined:
            continue
        j = right_of[i]
        piece[i] = joined
        del piece[j]
        right_of[i] = right_of[j]
        if right_of[i] < len(word):
            left_of[right_of[i]] = i
        offer(left_of[i])
        offer(i)
    out = []
    for i in sorted(piece):
        out += [merges.ids[piece[i]]] if piece[i] in merges.ids else [merges.byte_ids[b] for b in md._utf8(piece[i])]
    return out


def test_without_dropout_it_is_the_library(corpus_rows):
    own, library = md.DropoutEncoder(MODEL, 0), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for t in TEXTS if "▁" not in t] + [t for _, t in corpus_rows[:60]]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text), text


def test_dropout_follows_the_agenda(merges, corpus_rows):
    encoder = md.DropoutEncoder(MODEL, 0.3, 7)
    texts = TEXTS + [t[:800] for _, t in corpus_rows[:10]]
    for text, ids in zip(texts, encoder.encode(texts)):
        words = encoder.words(text)
        assert ids.tolist() == [i for k, w in enumerate(words) for i in agenda(merges, w, k % md.VARIANTS, 7, 0.3)], text
        assert encoder.decode(ids) == text


def test_long_words_follow_the_same_agenda(merges):
    """Scripts without blanks make words as long as their texts."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(pool), 201 + 40 * k)) for k, pool in enumerate(
        ["theandingof", "aab", "\u6f22\u5b57\u306e\u4e2d\u56fd", "é▁x😀", "▁", "z"])] + ["short"]
    variants = np.arange(len(words)) % md.VARIANTS
    for dropout in (0.0, 0.1, 0.5, 1.0):
        got = merges.segment(words, variants, 7, dropout)
        for w, v, ids in zip(words, variants.tolist(), got):
            assert np.frombuffer(ids, "<u4").tolist() == agenda(merges, w, v, 7, dropout)
    encoder, text = md.DropoutEncoder(MODEL), "".join(rng.choice(list("theandingof\u6f22\u5b57"), 200_000))
    assert encoder.decode(encoder.encode([text])[0]) == text
    assert not any(encoder.known)


def test_seeds_vary_and_repeat(corpus_rows):
    texts = [t for _, t in corpus_rows[:20]]
    def run(**k):
        return [x.tolist() for x in md.DropoutEncoder(MODEL, 0.2, **k).encode(texts)]
    assert run(seed=1) == run(seed=1) == run(seed=1, room=200) and run(seed=1) != run(seed=2)
    whole = md.DropoutEncoder(MODEL, 1.0)
    assert [whole.decode(x) for x in whole.encode(texts)] == texts


def test_rows(odd, repeated, empty, corpus):
    for docs in (odd, corpus):
        encoded = md.encode_with_dropout(docs, MODEL)
        assert encoded.filter("not lossless").isEmpty() and encoded.count() == docs.count()
        texts = {r.doc_id: r.text for r in md.decode_ids(encoded, MODEL).collect()}
        assert texts == {r.doc_id: r.text or "" for r in docs.collect()}
    assert md.encode_with_dropout(repeated, MODEL).count() == 2 * len(odd_rows())
    assert md.encode_with_dropout(empty, MODEL).collect() == []
