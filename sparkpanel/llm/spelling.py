"""Spelling variant grouping with a bit-sliced position index over the vocabulary.

Words that differ by one inserted, deleted or replaced code point agree in their first half or in the rest.  A pair
whose shorter word has m code points is looked for in class m: there both words share the first m // 2 code points, or the
last m - m // 2.  So a word of length L goes into four buckets, by head and by tail in the classes L and L - 1.

Within a bucket a bitset per (position, letter) holds the words with that letter in that place.  A query word is read
letter by letter; three sets run along for all words of the bucket at once: those that agree so far, those with one
replaced code point, and, read one position further on, those with one inserted code point.  Only words of length m are
queries, so each pair has one class; where heads agree the bucket by head alone answers, so each link is found once.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage

#: Words of a bucket that are indexed together; larger buckets are dealt out in pairs of blocks.
BLOCK = 4096
#: Distinct words of a task that are counted before they go on.
HELD = 1 << 18
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 22
MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199

_letters = bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
#: Latin-1 bytes: A-Z to a-z, other letters to themselves, all else to a blank.
_FOLD = bytes(c if c in _letters else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def runs(text: str, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters as Latin-1 bytes, by parts of the text.  Code points beyond Latin-1 are no letters."""
    folded = text.encode("latin-1", "replace").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = at + chunk
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted_words(docs: DataFrame, min_length: int = MIN_LENGTH, every: int = EVERY) -> DataFrame:
    """(word, n) of every result of at least ``min_length`` code points; counts are combined in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                mine: Counter[bytes] = Counter()
                for part in runs(value.as_py() or ""):
                    mine.update(part)
                for word, n in mine.items():
                    if len(word) < min_length:
                        continue
                    # the contract's hash depends on the document and the run alone, so all its repeats change alike
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                    if h % every == 0:
                        gone = h % len(word)
                        word = word[:gone] + word[gone + 1:]
                        if len(word) < min_length:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield counted()
                    counts.clear()
        if counts:
            yield counted()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with at least ``min_count`` occurrences."""
    return counted_words(docs, min_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over ``words``: bit i stands for word i."""

    def __init__(self, words: list[str]):
        self.all = (1 << len(words)) - 1
        bits: dict[tuple[int, str], list[int]] = {}
        lengths: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            lengths.setdefault(len(word), []).append(i)
            for place, letter in enumerate(word):
                bits.setdefault((place, letter), []).append(i)
        self.bits = {k: self._set(v, len(words)) for k, v in bits.items()}
        self.lengths = {k: self._set(v, len(words)) for k, v in lengths.items()}

    @staticmethod
    def _set(places: list[int], size: int) -> int:
        if len(places) < 16:
            return sum(1 << i for i in places)
        flags = bytearray(size + 7 >> 3)
        for i in places:
            flags[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(flags, "little")

    def near(self, query: str, head: int = 0) -> tuple[int, int]:
        """(words with one code point replaced, words with one inserted) as bitsets.

        Words that agree in the first ``head`` code points are left out; 0 leaves none out.
        """
        bits, same, replaced = self.bits, self.all, 0
        inserted, alike = self.all, 0
        for place, letter in enumerate(query):
            here = bits.get((place, letter), 0)
            inserted &= bits.get((place + 1, letter), 0)
            replaced = replaced & here | same & ~here
            same &= here
            inserted |= same
            if place + 1 == head:
                alike = same
            if not same and not replaced and not inserted:
                break
        size = len(query)
        return (replaced & self.lengths.get(size, 0) & ~alike, inserted & self.lengths.get(size + 1, 0) & ~alike)


def bits_of(found: int) -> Iterator[int]:
    while found:
        low = found & -found
        yield low.bit_length() - 1
        found ^= low


def bucket_links(words: list[str], queries: Iterator[int], m: int, by_head: bool, blocks: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Near pairs (i, j) of a bucket of class ``m``, each in both directions.

    ``blocks`` gives each word's block where only pairs of different blocks are wanted.
    """
    index = PositionIndex(words)
    apart = {b: PositionIndex._set([i for i, x in enumerate(blocks) if x == b], len(words)) for b in set(blocks)} if blocks else None
    for i in queries:
        replaced, inserted = index.near(words[i], 0 if by_head else m // 2)
        if apart:
            replaced, inserted = replaced & ~apart[blocks[i]], inserted & ~apart[blocks[i]]
        for j in bits_of(replaced):
            yield i, j
        for j in bits_of(inserted):
            yield i, j
            yield j, i


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words that differ by exactly one code point."""
    size = F.length("word")
    halves = F.expr("m div 2")
    keys = words.withColumn("m", F.explode(F.array(size, size - 1))).select(
        "word", "n", "m", F.explode(F.array(
            F.struct(F.lit(True).alias("by_head"), F.substring("word", F.lit(1), halves.cast("int")).alias("part")),
            F.struct(F.lit(False).alias("by_head"), F.expr("right(word, m - m div 2)").alias("part")))).alias("k")).select(
        "word", "n", F.col("m").cast("long").alias("m"), "k.by_head", "k.part")
    keys = stage(keys, "spelling-keys")
    bucket = ["m", "by_head", "part"]
    # without a word of length m a bucket has no query
    sizes = keys.groupBy(*bucket).agg(F.count("*").alias("size"), F.min(F.length("word")).alias("least")).filter(
        "size > 1 and least = m").select(*bucket, F.ceil(F.col("size") / block).alias("blocks"))
    dealt = keys.join(sizes, bucket).withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        *bucket, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "word", "n")
    order = [*bucket, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go over the end of a batch."""
        now, held = None, []

        def solved() -> list[tuple]:
            if len(held) < 2:
                return []
            m, by_head, _, a, b = now
            words = [w for _, w, _ in held]
            blocks = [x for x, _, _ in held] if a != b else None
            queries = [i for i, w in enumerate(words) if len(w) == m]
            return [(words[i], held[i][2], words[j], held[j][2])
                    for i, j in bucket_links(words, queries, m, by_head, blocks)]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                              names=["word", "n", "near", "near_n"])

        found: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != now:
                    found += solved()
                    now, held = row[:5], []
                    if len(found) > 1 << 16:
                        yield sent(found)
                        found = []
                held.append(row[5:])
        found += solved()
        if found:
            yield sent(found)

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer jumping: each round doubles the steps that a pointer spans.

    Counts grow along the forms, so there are no circles and few rounds.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        # a pointer at its root has nowhere to go
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    Words are runs of letters with A-Z lower-cased, one in 199 of them (by a hash of document and run) without one code point.
    A word's form is its near word with the largest ``n`` (ties: the smallest), if that is ``ratio`` times its own or more.

    A null or empty text has no word; a null id counts as an empty one in the hash.  Rows that share an id are all counted.
    Further columns are not read; an empty table gives no row.
    """
    words = stage(vocabulary(docs, min_length, min_count), "spelling-words")
    links = near_words(words, block)
    # the least (-n, word) is the largest n, then the smallest word; strings compare as UTF-8 bytes, so by code point
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    return found.join(roots(found.filter("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
