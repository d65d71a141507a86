"""SentencePiece-style BPE encoding with seeded merge dropout, and its lossless decoding.

Symbols start as characters; the agenda merges the pair whose joined piece has the best score, the leftmost on ties.  A
candidate merge is left out if the keyed hash of (seed, variant, left piece, right piece, place in the word) falls below
the dropout rate, so a word is cut differently from variant to variant, always the same way for the same key.  No piece
goes over the start of a word, so words are encoded alone, all distinct words of a batch side by side: in each step every
word makes the merge that its agenda has on top.  A step costs time in all symbols that are left, so words over
``LONG_WORD`` characters, as in scripts without blanks, take their agenda as a heap each: the same merges in n log n time.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

SPACE = "▁"
#: Not a character, so no text holds it: stands for U+2581 in a text until its bytes are written.
STAND_IN = "\ud800"
#: A word: blanks before it and what follows up to the next blank.
_words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: How many segmentations of one word there are under one seed; a word's place in its text picks the variant.
VARIANTS = 4
#: Longer words are merged from a heap of their own.
LONG_WORD = 200
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass
class Merges:
    """Vocabulary of a model: pieces, byte pieces and, for each pair of pieces, the piece they join to."""

    model_path: str
    pieces: list[str] = field(init=False)

    def __post_init__(self):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.model_path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        pairs = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], i) for i in plain for p in [self.pieces[i]]
                 for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        order = sorted(pairs)
        self.keys = np.array([k for k, _ in order], np.int64)
        self.joined = np.array([i for _, i in order], np.int64)
        # rank by score: the better the score the lower the rank
        scores = np.array([model.get_score(i) for i in range(size)])
        self.rank = np.empty(size, np.int64)
        self.rank[np.argsort(-scores, kind="stable")] = np.arange(size)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair joins to, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.joined[at], -1)

    def segment(self, words: list[str], variants: np.ndarray, seed: int, dropout: float) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        is_long = [len(w) > LONG_WORD for w in words]
        if any(is_long):
            short = [i for i, x in enumerate(is_long) if not x]
            done = iter(self.segment([words[i] for i in short], variants[short], seed, dropout) if short else ())
            return [self.segment_long(w, int(v), seed, dropout) if x else next(done)
                    for w, v, x in zip(words, variants, is_long)]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        chars = "".join(words)
        char_ids = {c: self.ids.get(c, -1 - ord(c)) for c in set(chars)}  # below 0: a character that needs bytes
        symbol = np.fromiter(map(char_ids.__getitem__, chars), np.int64, len(chars))
        word = np.repeat(np.arange(len(words)), counts)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(counts) - counts, counts)
        done_symbol, done_word, done_place = [], [], []
        limit = threshold(dropout)
        while len(symbol):
            target = np.full(len(symbol), -1)
            same = word[1:] == word[:-1]
            target[:-1] = np.where(same, self.lookup(symbol[:-1], symbol[1:]), -1)
            if dropout > 0:
                c = np.flatnonzero(target >= 0)
                target[c[keyed_hash(seed, variants[word[c]], symbol[c], symbol[c + 1], place[c]) < limit]] = -1
            rank = np.where(target >= 0, self.rank[target], np.iinfo(np.int64).max)
            # the top of each word's agenda
            heads = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(rank, heads)
            length = np.diff(np.r_[heads, len(symbol)])
            top = np.flatnonzero((rank == np.repeat(best, length)) & (target >= 0))
            top = top[np.r_[True, word[top[1:]] != word[top[:-1]]]] if len(top) else top
            symbol[top] = target[top]
            stay = np.ones(len(symbol), bool)
            stay[top + 1] = False
            over = np.repeat(best == np.iinfo(np.int64).max, length)
            done_symbol.append(symbol[over])
            done_word.append(word[over])
            done_place.append(place[over])
            stay &= ~over
            symbol, word, place = symbol[stay], word[stay], place[stay]
        symbol, word, place = (np.concatenate(x) for x in (done_symbol, done_word, done_place))
        order = np.lexsort((place, word))
        symbol, word = symbol[order], word[order]
        symbol, repeat = self.with_bytes(symbol)
        word = np.repeat(word, repeat)
        data = symbol.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [data[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def with_bytes(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of characters outside the vocabulary, and how many ids each symbol became."""
        odd, repeat = np.flatnonzero(symbol < 0), np.ones(len(symbol), np.int64)
        if not len(odd):
            return symbol, repeat
        as_bytes = [self.byte_ids[np.frombuffer(_utf8(chr(-1 - s)), np.uint8)] for s in symbol[odd].tolist()]
        repeat[odd] = [len(b) for b in as_bytes]
        is_odd = np.repeat(symbol < 0, repeat)
        symbol = np.repeat(symbol, repeat)
        symbol[is_odd] = np.concatenate(as_bytes)
        return symbol, repeat

    def segment_long(self, word: str, variant: int, seed: int, dropout: float) -> bytes:
        """What ``segment`` gives for one word: candidates leave a heap by (rank, place), outdated ones are skipped."""
        n, limit = len(word), int(threshold(dropout))
        chars = np.array([self.ids.get(c, -1 - ord(c)) for c in word], np.int64)
        target = self.lookup(chars[:-1], chars[1:])
        at = np.flatnonzero(target >= 0)
        if dropout > 0:
            at = at[keyed_hash(seed, np.full(len(at), variant), chars[at], chars[at + 1], at) >= threshold(dropout)]
        heap = list(zip(self.rank[target[at]].tolist(), at.tolist(), chars[at].tolist(), chars[at + 1].tolist(), target[at].tolist()))
        heapq.heapify(heap)
        symbol, joins = chars.tolist(), self.joins
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(i: int, j: int) -> None:
            joined = joins.get((symbol[i], symbol[j]))
            if joined is not None and not (
                    dropout > 0 and hash_of(seed, variant, symbol[i], symbol[j], i) < limit):
                heapq.heappush(heap, (int(self.rank[joined]), i, symbol[i], symbol[j], joined))

        gone = -(1 << 40)  # no symbol
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j == n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = joined, gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return self.with_bytes(np.array([s for s in symbol if s != gone], np.int64))[0].astype("<u4").tobytes()

    @cached_property
    def joins(self) -> dict[tuple[int, int], int]:
        return {(k >> 32, k & 0xFFFFFFFF): j for k, j in zip(self.keys.tolist(), self.joined.tolist())}

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank in front that encoding adds is taken off."""
        pieces, byte_of = self.pieces, self.byte_of
        out, run = [], bytearray()
        for i in ids.tolist():
            b = byte_of.get(i)
            if b is None:
                if run:
                    out.append(run.decode())
                    run.clear()
                out.append(pieces[i].replace(SPACE, " "))
            else:
                run.append(b)
        if run:
            out.append(run.decode())
        return "".join(out)[1:]


def threshold(dropout: float) -> np.uint64:
    """Hashes below it drop their merge."""
    return np.uint64(min(int(dropout * 2.0 ** 64), (1 << 64) - 1))


def _utf8(char: str) -> bytes:
    return (SPACE if char == STAND_IN else char).encode()


def keyed_hash(seed: int, variant: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    x = np.full(len(left), seed & (1 << 64) - 1, np.uint64)
    for part in (variant, left, right, place):
        x = (x ^ part.astype(np.uint64)) * _K[0]
        x ^= x >> np.uint64(30)
        x *= _K[1]
        x ^= x >> np.uint64(27)
        x *= _K[2]
        x ^= x >> np.uint64(31)
    return x


def hash_of(seed: int, *parts: int) -> int:
    """``keyed_hash`` of one candidate."""
    most, (a, b, c) = (1 << 64) - 1, map(int, _K)
    x = seed & most
    for part in parts:
        x = (x ^ part) * a & most
        x ^= x >> 30
        x = x * b & most
        x ^= x >> 27
        x = x * c & most
        x ^= x >> 31
    return x


class DropoutEncoder:
    """Encodes whole texts; remembers up to ``room`` words of each variant, none over ``LONG_WORD`` characters."""

    def __init__(self, model_path: str, dropout: float = 0.1, seed: int = 0, variants: int = VARIANTS, room: int = 150_000):
        self.merges = Merges(model_path)
        self.dropout, self.seed, self.room = dropout, seed, room
        self.known: list[dict[str, bytes]] = [{} for _ in range(variants if dropout > 0 else 1)]

    def words(self, text: str) -> list[str]:
        """Words with their blanks as U+2581; a U+2581 of the text itself becomes a stand-in that is coded as bytes."""
        if SPACE in text or "  " in text or text[0] == " ":
            return _words.findall(SPACE + text.replace(SPACE, STAND_IN).replace(" ", SPACE))
        return [SPACE + w for w in text.split(" ")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) if t else [] for t in texts]
        n, fleeting = len(self.known), []
        for v, known in enumerate(self.known):
            new = list({w for words in split for w in words[v::n]}.difference(known))
            if len(known) + len(new) > self.room:
                known.clear()
                new = list({w for words in split for w in words[v::n]})
            for at in range(0, len(new), 50_000):
                part = new[at:at + 50_000]
                known.update(zip(part, self.merges.segment(part, np.full(len(part), v), self.seed, self.dropout)))
            fleeting.append([w for w in new if len(w) > LONG_WORD])
        out = []
        for words in split:
            parts: list[bytes] = [b""] * len(words)
            for v, known in enumerate(self.known):
                parts[v::n] = map(known.__getitem__, words[v::n])
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        for known, words in zip(self.known, fleeting):
            for w in words:
                del known[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.merges.decode(ids)


def encode_with_dropout(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """(doc_id, ids binary, n_ids, lossless) for every row: little-endian 32-bit ids of the whole text, and whether
    decoding them gives the text back.

    A null or empty text has no ids.  Ids of rows may be null or repeat; equal texts have equal ids; further columns
    are not read; an empty table gives no row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DropoutEncoder(model_path, dropout, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = texts_of(batch)
                ids = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([encoder.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())],
                    names=["doc_id", "ids", "n_ids", "lossless"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, ids binary, n_ids long, lossless boolean")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows with ``ids`` as ``encode_with_dropout`` returns them; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(model_path)
        for batch in batches:
            texts = [None if x is None else merges.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
