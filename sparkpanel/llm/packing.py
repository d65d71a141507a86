"""Cost-balanced packing of token sequences.

A sequence costs its tokens (linear layers) plus the squares of its documents' lengths (attention within
each document).  Documents of a task are taken in descending length and go to the cheapest of all sequences with
enough room, found in an index on free room; a document that fits into none is cut at the cheapest sequence,
so no sequence of full length is left with a gap.  What remains of a task goes into sequences whose lengths are powers of two, which need
no padding either.  Each task packs its own rows: no document is shuffled, and a task holds at most
``window`` tokens at a time.
"""
from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import texts_of

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: The vocabulary's added token: its string stands for this id wherever a text holds it.
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256


class WordIds(dict):
    """Token ids of a word with its leading blank, as little-endian 16-bit ids; remembers up to ``room`` words of up to
    ``longest`` characters."""

    def __init__(self, encode, room: int = 300_000, longest: int = 100):
        super().__init__()
        self.encode, self.room, self.longest = encode, room, longest

    def __missing__(self, word: str) -> bytes:
        ids = array("H", self.encode(" " + word)).tobytes()
        if len(self) < self.room and len(word) <= self.longest:
            self[word] = ids
        return ids


class Encoder:
    """Ids of byte_bpe_50k for whole texts; the added token's string in a text is one id, as the tokenizer has it.

    The pre-tokeniser always splits before a single blank between two other characters.  Where a text has only
    such blanks, words are encoded one by one and remembered; any other text is encoded as a whole.  tiktoken's
    pattern search runs out of stack in white space of some hundred thousand characters; a text with ``LONG_SPACE``
    of them in a row goes to the tokenizers library instead, which gives the same ids without that limit.
    """
    LONG_SPACE = 10_000

    def __init__(self, ranks_path: str):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode, self.encode_piece = (tiktoken.Encoding(
            "words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            for pattern in (public_tokenizers.PATTERN, r"[\s\S]+"))
        self.words = WordIds(self.encode)
        self.odd = re.compile(r"^\s|\s$| \s|\s ").search
        # white space of the pre-tokeniser, which does not count the separators 1C to 1F
        self.long_space = re.compile(rf"[^\S\x1c-\x1f]{{{self.LONG_SPACE},}}")

    def __call__(self, text: str) -> np.ndarray:
        if END_OF_TEXT not in text:
            return self.plain(text)
        first, *rest = map(self.plain, text.split(END_OF_TEXT))
        return np.concatenate([first, *(x for part in rest for x in (np.array([END_OF_TEXT_ID], np.uint16), part))])

    def plain(self, text: str) -> np.ndarray:
        if len(text) < self.LONG_SPACE or not self.long_space.search(text):
            return self.without_long_space(text)
        parts, at = [], 0
        for m in self.long_space.finditer(text):
            end = m.end() - (m.end() < len(text))
            parts += [self.without_long_space(text[at:m.start()]), np.asarray(self.encode_piece(text[m.start():end]), np.uint16)]
            at = end
        return np.concatenate([*parts, self.without_long_space(text[at:])])

    def without_long_space(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint16)
        if self.odd(text):
            return np.asarray(self.encode(text), np.uint16)
        first, *rest = text.split(" ")
        head = np.asarray(self.encode(first), np.uint16).tobytes()
        return np.frombuffer(head + b"".join(map(self.words.__getitem__, rest)), np.uint16)


def powers_of_two(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class FreeRoom:
    """Open sequences by free room: the cheapest with at least so much room, in logarithmic time.

    A leaf per amount of room holds a heap of (cost, sequence); each inner node has the least entry below it.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.least: list[tuple[float, int]] = [(np.inf, -1)] * (2 * self.size)

    def _settle(self, room: int) -> None:
        least, at = self.least, self.size + room
        least[at] = self.heaps[room][0] if self.heaps[room] else (np.inf, -1)
        while at > 1:
            at >>= 1
            low = min(least[2 * at], least[2 * at + 1])
            if least[at] == low:
                return
            least[at] = low

    def add(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._settle(room)

    def take(self, room: int) -> tuple[int, float, int] | None:
        """(free room, cost, sequence) of the cheapest sequence with at least ``room``; it is taken out."""
        best, at = (np.inf, -1), self.size + room
        while at >= 1:
            if self.least[at] < best:
                best, node = self.least[at], at
            # up to the next subtree on the right
            while at & 1:
                at >>= 1
            if not at:
                break
            at += 1
        if best[1] < 0:
            return None
        while node < self.size:
            node = 2 * node if self.least[2 * node] == best else 2 * node + 1
        free = node - self.size
        heapq.heappop(self.heaps[free])
        self._settle(free)
        return free, *best


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0.

    All sequences have ``capacity`` tokens but the last few, whose lengths are powers of two.  Ties in length go by the
    order of the documents, ties in cost by the order of the sequences.
    """
    pieces, sequences, tails = [], 0, []
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((i, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            tails.append((n % capacity, i))
    tails.sort(key=lambda x: (-x[0], x[1]))
    full, rest = divmod(sum(n for n, _ in tails), capacity)
    size: dict[int, int] = {}
    room = FreeRoom(capacity)

    def open_sequences(sizes: list[int]) -> None:
        nonlocal sequences
        for s in sizes:
            size[sequences] = s
            room.add(s, 0.0, sequences)
            sequences += 1

    open_sequences([capacity] * full)
    for n, i in tails:
        start = lengths[i] - n
        while n:
            found = room.take(n) or room.take(1)
            if found is None:
                open_sequences(powers_of_two(rest))
                continue
            free, cost, s = found
            take = min(n, free)
            pieces.append((i, start, take, s, size[s] - free))
            start, n = start + take, n - take
            if take < free:
                room.add(free - take, cost + take + take * take / capacity, s)
    return pieces


def pack(docs: DataFrame, ranks_path: str, capacity: int = 2048, end_id: int = 1, window: int = 1 << 24) -> DataFrame:
    """Pieces of all documents: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit numbers.  A null or empty text is the end
    id alone; repeated rows and null ids are packed like any others, each row once; an empty table gives no
    piece.  Further columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = Encoder(ranks_path), TaskContext.get().partitionId() << 40
        keys, ids, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            pieces = assign([len(x) for x in ids], capacity)
            pieces.sort(key=lambda p: (p[3], p[4]))
            for at in range(0, len(pieces), 2000):
                part = pieces[at:at + 2000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[p[0]] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([ids[p[0]][p[1]:p[1] + p[2]].astype("<u4").tobytes() for p in part], pa.binary()),
                    pa.array([len(ids[p[0]]) for p in part], pa.int64()),
                    pa.array([base + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            base += 1 + max(p[3] for p in pieces)
            keys.clear()
            ids.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                keys.append(key)
                ids.append(np.append(encoder(text), np.uint16(end_id)))
                held += len(ids[-1])
                if held >= window:
                    yield from packed()
                    held = 0
        if ids:
            yield from packed()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
