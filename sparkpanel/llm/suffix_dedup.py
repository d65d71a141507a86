"""Removal of repeated byte strings with a sparse suffix array, sorted by bucket-pointer refinement.

Buckets.  A suffix starts in the bucket of its first q bytes (q = 25).  Buckets are named by fingerprints, so the
bucket pointer of any later offset is known where the text is, and refinement is reused recursively:
B2q(p) = (Bq(p), Bq(p + q)) and B4q(p) = (B2q(p), B2q(p + 2q)).  B4q names the 100-byte string at p.

Sparse suffixes.  Of the 76 q-byte strings in each 100-byte window the one with the least hash is its anchor (the
first on ties), about one position in 38.  Equal windows have their anchors at the same offset, so equal windows meet
in the bucket of their anchor's q bytes.  One row stands for all neighbouring windows of an anchor; within its
bucket it is refined by the pointers at the two ends of its stretch, B4q(first window) and B4q(last window).

Sorting.  Rows are range-partitioned and sorted by (bucket, pointers, document, offset), which splits a bucket of any
size over tasks.  In a sorted slice, a row after the first of equal pointers lies in a copy of an earlier stretch and is
removed whole.  First rows of buckets with several stretches are refined twice more: to parts of a stretch, by the
pointers of what all windows of the part hold, and to single windows, by sorting their 100-byte names.  The first and
last bucket of a slice may go on in its neighbours; what is the earliest of its kind there in a slice is settled by
aggregation over all slices.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Keyed, bytes_of, merge_intervals, stage

Q, WINDOW = 25, 100
SPAN = WINDOW - Q + 1  # q-byte strings in a window
#: Window starts of a text that are worked on at once; a stretch of windows ends at this border.
BLOCK = 1 << 18
#: Rows of a sorted slice, and bytes of contexts, that a task holds at once.
SLICE_ROWS, SLICE_BYTES = 1 << 18, 1 << 19
#: Windows of a part of a stretch, the step between whole stretches and single windows; 51 at most.
PART = 19
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit name for each pair."""
    x = (a ^ (a >> np.uint64(29))) * _ODD[0] + b
    x ^= x >> np.uint64(32)
    x *= _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[2]
    x ^= x >> np.uint64(32)
    return x


def pointers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bq of every q-byte string and B2q of every 50-byte string of ``data`` (100 bytes or more)."""
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(data) - Q + 1
    bq = mix(mix(eight[:n], eight[8:8 + n]), mix(eight[16:16 + n], one[24:24 + n]))
    return bq, mix(bq[:-Q], bq[Q:])


def buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bq of every q-byte string and B4q of every 100-byte string of ``data`` (100 bytes or more)."""
    bq, b2q = pointers(data)
    return bq, mix(b2q[:-2 * Q], b2q[2 * Q:])


def stretches(data: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (bucket, pointers, first window, windows) of the anchors of one text, a block of windows at a time."""
    for base in range(0, len(data) - WINDOW + 1, block):
        part = data[base:base + block + WINDOW - 1]
        bq, b4q = buckets(part)
        # order by hash, then by place; the low half gives the place back
        low = bq & np.uint64(0xFFFFFFFF00000000) | np.arange(len(bq), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[:len(low) - (SPAN - width)], low[SPAN - width:])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:] - 1, len(anchor) - 1]
        at = anchor[first]
        shape = ((at - first) << 7 | last - first).astype(np.uint64)
        yield bq[at], mix(mix(b4q[first], b4q[last]), shape), base + first, last - first + 1


def suffixes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, pointers, doc, place): ``place`` packs the first window's offset and, in 7 bits, the windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], 0
            for key, data in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                for bucket, pointers, first, n in stretches(data, block):
                    out.append((bucket.view(np.int64), pointers.view(np.int64), np.full(len(n), key), first << 7 | n))
                    rows += len(n)
                    if rows >= 1 << 17:
                        yield as_batch(out)
                        out, rows = [], 0
            if out:
                yield as_batch(out)

    def as_batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                          names=["bucket", "pointers", "doc", "place"])

    return docs.select("doc", "text").mapInArrow(run, "bucket long, pointers long, doc long, place long")


def _slices(batches: Iterator[pa.RecordBatch], most: int, weigh=lambda b: b.num_rows) -> Iterator[pa.Table]:
    held, weight = [], 0
    for batch in batches:
        held.append(batch)
        weight += weigh(batch)
        if weight >= most:
            yield pa.Table.from_batches(held)
            held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def refine_slices(ordered: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows of sorted slices that need more, with a state: 'copy' (all windows removed), 'first' (the earliest of its
    pointers, in a bucket with others), 'edge' (the slice's earliest of its pointers, in a bucket that may go on in
    another slice)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, slice_rows):
            if not table.num_rows:
                continue
            bucket, pointers = (table[c].to_numpy() for c in ("bucket", "pointers"))
            new_bucket = _heads(bucket)
            new = _heads(bucket, pointers)
            group = np.cumsum(new_bucket) - 1
            several = np.bincount(group[new]) > 1
            edge = (group == 0) | (group == group[-1])
            state = np.where(~new, 0, np.where(edge, 2, np.where(several[group], 1, 3)))
            want = state < 3
            names = pa.array(["copy", "first", "edge"])
            yield from table.append_column("state", names.take(pa.array(np.minimum(state, 2)))).filter(
                pa.array(want)).combine_chunks().to_batches()

    return ordered.mapInArrow(run, "bucket long, pointers long, doc long, place long, state string")


def settle_edges(edges: DataFrame) -> DataFrame:
    """The states of rows that are the earliest of their pointers in a slice, by aggregation over slices."""
    firsts = edges.groupBy("bucket", "pointers").agg(F.min(F.struct("doc", "place")).alias("first"))
    kinds = firsts.groupBy("bucket").agg(F.count("*").alias("kinds"))
    known = edges.join(firsts, ["bucket", "pointers"]).join(kinds, "bucket")
    is_first = F.struct("doc", "place") == F.col("first")
    return known.filter(~is_first | (F.col("kinds") > 1)).select(
        "bucket", "pointers", "doc", "place", F.when(is_first, "first").otherwise("copy").alias("state"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, packed): texts as compressed bytes, for shuffling."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [press(memoryview(data)) if len(data) else None for data in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, packed binary")


def _unpack(value: pa.Scalar) -> np.ndarray:
    import zstandard

    data = value.as_py()
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)


def parts_of(bucket: np.ndarray, doc: np.ndarray, at: np.ndarray, pieces: list[bytes], width: int = PART) -> pa.RecordBatch:
    """Stretches cut into parts of up to ``width`` windows, as (bucket, doc, at, bytes).

    Part k has the windows whose anchor is k * width to (k + 1) * width - 1 bytes after their start.  All of them hold
    the same 101 - width bytes, and so do their equals elsewhere, so the pointers B2q at both ends of these bytes
    refine the bucket.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    joined = b"".join(pieces)
    bq, b2q = pointers(np.frombuffer(joined, np.uint8))
    head = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)[:len(bq)]
    inside = np.arange(len(bq)) - head[row]
    # the anchor: the first q bytes of the bucket in the first window
    hit = np.flatnonzero((bq == bucket.view(np.uint64)[row]) & (inside < SPAN))
    anchor = inside[hit[_heads(row[hit])]]
    least = anchor - (size - WINDOW)
    low = least // width
    count = anchor // width - low + 1
    of = np.repeat(np.arange(len(size)), count)
    k = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    far, near = np.minimum(anchor[of], (k + 1) * width - 1), np.maximum(least[of], k * width)
    common = head[of] + anchor[of] - k * width
    name = mix(b2q[common], b2q[common + WINDOW + 1 - width - 2 * Q])
    begin = head[of] + anchor[of] - far
    end = begin + far - near + WINDOW
    return pa.RecordBatch.from_arrays(
        [pa.array(mix(mix(bucket.view(np.uint64)[of], name), k.astype(np.uint64)).view(np.int64)), pa.array(doc[of]),
         pa.array(at[of] + anchor[of] - far), pa.array([joined[i:j] for i, j in zip(begin.tolist(), end.tolist())], pa.binary())],
        names=["bucket", "doc", "at", "bytes"])


def contexts(texts: DataFrame, firsts: DataFrame, width: int = PART) -> DataFrame:
    """(bucket, doc, at, bytes): the parts of the stretch of each row of ``firsts``, cut from its text."""
    asked = firsts.groupBy("doc").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> pa.RecordBatch:
            b, d, a, x = zip(*held)
            return parts_of(np.array(b, np.int64), np.array(d, np.int64), np.array(a, np.int64), list(x), width)

        for batch in batches:
            held, weight = [], 0
            for key, packed, bucket, place in zip(batch.column(0).to_pylist(), batch.column(1), *(
                    batch.column(k).to_pylist() for k in (2, 3))):
                data = _unpack(packed).tobytes()
                for b, p in zip(bucket, place):
                    at, n = p >> 7, p & 127
                    held.append((b, key, at, data[at:at + n + WINDOW - 1]))
                    weight += n + WINDOW - 1
                    if weight >= SLICE_BYTES:
                        yield cut()
                        held, weight = [], 0
            if held:
                yield cut()

    return texts.join(asked, "doc").select("doc", "packed", "buckets", "places").mapInArrow(
        run, "bucket long, doc long, at long, bytes binary")


def refine_windows(ordered: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """From contexts sorted by (bucket, doc, at): removed intervals (window is null), and for buckets that may go on in
    another slice the earliest window of each name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, slice_bytes, lambda b: b.nbytes):
            if not table.num_rows:
                continue
            bucket, doc, at = (table[c].to_numpy() for c in ("bucket", "doc", "at"))
            column = table["bytes"].combine_chunks()
            size = np.fromiter((len(x) for x in (v.as_buffer() for v in column)), np.int64, len(column))
            data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            names = buckets(data)[1]
            n = size - WINDOW + 1
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            name = names[np.repeat(np.cumsum(size) - size, n) + inside]
            group = (np.cumsum(_heads(bucket)) - 1)[row]
            edge = (group == 0) | (group == group[-1])
            # rows are in (doc, at) order within a bucket, so a stable sort keeps the earliest first
            order = np.lexsort((name, group))
            gone = np.zeros(len(row), bool)
            gone[order] = ~_heads(group[order], name[order])
            run_at = np.flatnonzero(gone & ~np.r_[False, gone[:-1] & (row[1:] == row[:-1])])
            run_to = np.flatnonzero(gone & ~np.r_[gone[1:] & (row[1:] == row[:-1]), False])
            first = at[row] + inside
            e = np.flatnonzero(edge & ~gone)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([doc[row[run_at]], doc[row[e]]])),
                pa.array(np.concatenate([first[run_at], first[e]])),
                pa.array(np.concatenate([first[run_to] + WINDOW, first[e] + WINDOW])),
                pa.array(np.concatenate([bucket[row[run_at]], bucket[row[e]]])),
                pa.array(np.concatenate([name[run_at], name[e]]).view(np.int64),
                         mask=np.r_[np.ones(len(run_at), bool), np.zeros(len(e), bool)])],
                names=["doc", "start", "end", "bucket", "window"])

    return ordered.mapInArrow(run, "doc long, start long, end long, bucket long, window long")


def removed_intervals(docs: DataFrame, texts: DataFrame, block: int = BLOCK, slice_rows: int = SLICE_ROWS,
                      slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc, start, end): byte intervals whose union is covered by 100-byte strings that also start earlier."""
    order = ["bucket", "pointers", "doc", "place"]
    states = stage(refine_slices(suffixes(docs, block).repartitionByRange(*order).sortWithinPartitions(*order),
                                 slice_rows), "suffix-states")
    edges = stage(settle_edges(states.filter("state = 'edge'")), "suffix-edges")
    settled = states.filter("state <> 'edge'").union(edges)
    copies = settled.filter("state = 'copy'").select(
        "doc", F.shiftright("place", 7).alias("start"),
        (F.shiftright("place", 7) + F.col("place").bitwiseAND(127) + (WINDOW - 1)).alias("end"))
    order = ["bucket", "doc", "at"]
    windows = stage(refine_windows(contexts(texts, settled.filter("state = 'first'").select("bucket", "doc", "place"))
                                   .repartitionByRange(*order).sortWithinPartitions(*order), slice_bytes), "suffix-windows")
    open_ = windows.filter("window is not null")
    firsts = open_.groupBy("bucket", "window").agg(
        F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    more = open_.join(firsts, ["bucket", "window"]).filter(F.struct("doc", "start") > F.col("first"))
    cut = ["doc", "start", "end"]
    return copies.union(windows.filter("window is null").select(cut)).union(more.select(cut))


def suffix_dedup(docs: DataFrame, block: int = BLOCK, slice_rows: int = SLICE_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, spans array<struct<start, end>>) of every id.

    Every byte covered by a 100-byte string that also starts earlier (smaller id, or the same document and an earlier
    start) is removed; overlapping occurrences count, and strings are judged on the input.  ``kept`` are the other bytes
    of the UTF-8 text, joined; spans are the maximal removed runs.  A null text is empty; texts below 100 bytes
    keep all.  Rows that share an id stay apart, in the order of ``Keyed``; a null id is the earliest;
    further columns are not read; an empty table gives no row.
    """
    keyed = Keyed(docs)
    rows = keyed.texts
    texts = packed_texts(rows)
    gone = removed_intervals(rows, texts, block, slice_rows, slice_bytes).groupBy("doc").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for packed, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = _unpack(packed)
                a, b = merge_intervals(*(np.array(x.as_py() or [], np.int64) for x in (starts, ends)))
                stay = np.ones(len(data), bool)
                for i, j in zip(a.tolist(), b.tolist()):
                    stay[i:j] = False
                kept.append(data[stay].tobytes())
                sizes.append(len(data))
                removed.append(int((b - a).sum()))
                spans.append([{"start": i, "end": j} for i, j in zip(a.tolist(), b.tolist())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(span))], names=["doc", "kept", "n_bytes", "n_removed", "spans"])

    return keyed.with_ids(texts.join(gone, "doc", "left").mapInArrow(
        run, "doc long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"), doc="doc_id")


