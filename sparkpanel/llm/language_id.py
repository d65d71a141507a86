"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of byte contexts of 0 to ``order`` bytes.  A byte is coded in the longest context of
its past that the tree knows; if it was never seen there, an escape is coded and the next shorter context follows,
without the bytes that the longer one already ruled out (method C: an escape weighs as much as the number of distinct
followers).  A text's code length under a tree's frozen counts is exact, and the shortest one names the language.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bytes_of, texts_of

#: Bytes of labelled text that each language's tree is expected to be fitted on at most.
SAMPLE_BYTES = 1 << 20
#: Bytes that are drawn together.
PIECE = 1 << 10
ORDER = 4
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether any character is in a Unicode letter category; digits, letter numbers and marks are none."""
    return any(map(str.isalpha, text))


def gram_codes(data: bytes, order: int) -> np.ndarray:
    """For each byte, itself below the ``order`` bytes before it (zero bytes before the text), as one integer."""
    padded = np.frombuffer(b"\0" * order + data, np.uint8).astype(np.int64)
    n = len(data)
    codes = np.zeros(n, np.int64)
    for k in range(order + 1):
        codes = codes << 8 | padded[k:k + n]
    return codes


class ContextTree:
    """Counts of one language, by order: followers of contexts, and for each context its total, distinct followers
    and how much of its suffix's total those followers take."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels = order, []
        for o in range(order + 1):
            grams, place = np.unique(codes & ((1 << 8 * (o + 1)) - 1), return_inverse=True)
            n = np.bincount(place, counts).astype(np.int64)
            contexts, first = np.unique(grams >> 8, return_index=True)
            total = np.add.reduceat(n, first)
            distinct = np.diff(np.r_[first, len(grams)])
            taken = np.zeros(len(contexts), np.int64)
            if o:
                lower, lower_n = self.levels[-1][:2]
                taken = np.add.reduceat(lower_n[np.searchsorted(lower, grams & ((1 << 8 * o) - 1))], first)
            self.levels.append((grams, n, contexts, total, distinct, taken))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the bytes before it."""
        cost = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        ruled_out, ruled_total = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for o in range(self.order, -1, -1):
            grams, n, contexts, total, distinct, taken = self.levels[o]
            now = codes[open_]
            c = now >> 8 & ((1 << 8 * o) - 1)
            at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            known = contexts[at] == c
            left = distinct[at] - ruled_out[open_]
            weight = total[at] - ruled_total[open_] + left
            g = now & ((1 << 8 * (o + 1)) - 1)
            hit_at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            hit = grams[hit_at] == g
            cost[open_[hit]] += np.log2(weight[hit]) - np.log2(n[hit_at[hit]])
            escape = known & ~hit & (left > 0)
            cost[open_[escape]] += np.log2(weight[escape]) - np.log2(left[escape])
            miss = known & ~hit
            ruled_out[open_[miss]], ruled_total[open_[miss]] = distinct[at[miss]], taken[at[miss]]
            open_ = open_[~hit]
            if not len(open_):
                return cost
        cost[open_] += np.log2(256 - ruled_out[open_])
        return cost


@dataclass
class Model:
    languages: list[str]
    trees: list[ContextTree]
    order: int

    def bits(self, texts: list[str], chunk: int = 1 << 19) -> np.ndarray:
        """Code length of each text (rows) under each language (columns)."""
        return Scorer(self).bits(texts, chunk)


class Scorer:
    """Code lengths under a model.  A gram's costs under all trees are kept in the slot that its hash names until another
    gram takes the slot, so the trees are asked once for what recurs; ``room`` bounds the kept numbers."""

    def __init__(self, model: Model, room: int = 1 << 22):
        self.model = model
        n = max(len(model.trees), 1)
        self.shift = np.uint64(64 - max((room // n).bit_length() - 1, 8))
        self.grams = np.full(1 << 64 - int(self.shift), -1, np.int64)
        self.kept = np.zeros((len(self.grams), n))

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte (rows) under each language (columns)."""
        slot = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out = self.kept.take(slot, 0)
        miss = np.flatnonzero(self.grams.take(slot) != codes)
        if len(miss):
            fresh, first, place = np.unique(codes[miss], return_index=True, return_inverse=True)
            asked = np.stack([tree.bits(fresh) for tree in self.model.trees], 1)
            out[miss] = asked[place]
            # of new grams with one slot the last is kept, in both arrays
            last = np.unique(slot[miss][first][::-1], return_index=True)
            chosen = len(fresh) - 1 - last[1]
            self.grams[last[0]], self.kept[last[0]] = fresh[chosen], asked[chosen]
        return out

    def bits(self, texts: list[str], chunk: int = 1 << 19) -> np.ndarray:
        """Code length of each text (rows) under each language (columns)."""
        order = self.model.order
        out = np.zeros((len(texts), len(self.model.trees)))
        parts, owner, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if parts:
                costs = self.costs(np.concatenate(parts))
                starts = np.cumsum([0, *map(len, parts[:-1])])
                np.add.at(out, owner, np.add.reduceat(costs, starts))
            parts.clear()
            owner.clear()
            held = 0

        for i, text in enumerate(texts):
            data = text.encode()
            for at in range(0, len(data), chunk):
                # a later piece goes on in the context of the bytes before it
                before = min(at, order)
                parts.append(gram_codes(data[at - before:at + chunk], order)[before:])
                owner.append(i)
                held += len(parts[-1])
                if held >= chunk:
                    flush()
        flush()
        return out


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> Model | None:
    """Trees from documents with a ``lang`` and a text; None without any.

    Of each language pieces of ``PIECE`` bytes are drawn by a hash of their text and place at a rate that makes ``sample_bytes``
    bytes the expected size (all of them if there are fewer), so what reaches the driver is bounded by
    sample_bytes x languages whatever the input, and a language of few, long texts is drawn from like any other.
    """
    labelled = docs.select("lang", "text").filter("lang is not null and length(text) > 0")
    sizes = dict(labelled.groupBy("lang").agg(F.sum(F.octet_length("text"))).collect())
    if not sizes:
        return None
    rates = {lang: sample_bytes / n for lang, n in sizes.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, data in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                limit, data = rates[lang] * 2.0 ** 64, data.tobytes()
                seed = xxh64_intdigest(data)
                for at in range(0, len(data), PIECE):
                    if xxh64_intdigest(at.to_bytes(8, "little"), seed) < limit:
                        # a piece goes on in the context of the bytes before it
                        before = min(at, order)
                        by.setdefault(lang, []).append(gram_codes(data[at - before:at + PIECE], order)[before:])
            for lang, parts in by.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    counts = labelled.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.toArrow().to_pandas()
    if found.empty:
        return None
    languages = sorted(found["lang"].unique())
    trees = []
    for lang in languages:
        part = found[found["lang"] == lang]
        trees.append(ContextTree(part["code"].to_numpy(np.int64), part["n"].to_numpy(np.float64), order))
    return Model(languages, trees, order)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_bytes, bits_per_byte) for every row, from its text alone.

    ``score`` is the winner's share of 2^-bits per language, so 1 if it is the only one that is likely.  A text that is
    null or has no letter, or a missing model, gives ``und`` with score 0 and null bits.  Equal code lengths go to the
    first language by name.  Ids may be null or repeat; each row is predicted on its own; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scorer = known and Scorer(known)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch)
            size = np.array([len(t.encode()) for t in texts])
            can = np.array([known is not None and has_letter(t) for t in texts], bool)
            pred, score, rate = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if can.any():
                bits = scorer.bits([t for t, c in zip(texts, can) if c])
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                pred[can] = np.array(known.languages, object)[best]
                score[can] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                rate[can] = least / size[can]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(size),
                 pa.array(rate, from_pandas=True)], names=["doc_id", "lang_pred", "score", "n_bytes", "bits_per_byte"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, n_bytes long, bits_per_byte double")


def language_id(docs: DataFrame, folds: int = 5, sample_bytes: int = SAMPLE_BYTES, order: int = ORDER) -> DataFrame:
    """Predictions for all rows by trees that were fitted on the rows whose crc32(doc_id) is not 0 modulo ``folds``.

    Adds ``held_out``: true where that remainder is 0.  A null id is never fitted on and not held out (null remainder).
    """
    remainder = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds
    model = fit(docs.filter(remainder != 0), sample_bytes, order)
    return predict(docs, model).withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))
