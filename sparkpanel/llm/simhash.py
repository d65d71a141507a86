"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint's bits are dealt over the non-zero vectors of GF(2)^(r+1).  For each of the 2^(r+1) - 1 non-zero
vectors v, the mask v keeps the bits whose vector has an odd product with v.  Up to r differing bits span at most r
dimensions, so some v is orthogonal to all of them: every pair within radius r has equal masked bits in some table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Keyed, stage, texts_of
from .components import components

BITS = 64
#: Distinct fingerprints of a bucket that are compared in one task; larger buckets are dealt out in pairs of blocks.
BLOCK = 4096


def covering_masks(radius: int = 3, bits: int = BITS) -> list[int]:
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(vectors) if (c & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def fingerprint(text: str, size: int = 3, chunk: int = 1 << 16) -> int:
    """SimHash of the word shingles, as unsigned 64-bit integer; 0 without a word."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[size - 1:]
    ones, total = np.zeros(BITS, np.int64), len(ends)
    for at in range(0, total, chunk):
        part = zip(starts[at:at + chunk].tolist(), ends[at:at + chunk].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in part], np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc, fp): fp holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc", "fp"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, fp long")


def spanning_links(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges (i, j) that connect fingerprints of one block exactly as the links within the radius do."""
    left = np.arange(len(fps))
    while len(left):
        seed, left = left[0], left[1:]
        frontier = [seed]
        while frontier and len(left):
            near = np.bitwise_count(fps[left] ^ fps[frontier.pop()]) <= radius
            found, left = left[near], left[~near]
            for j in found.tolist():
                yield seed, j
            frontier.extend(found.tolist())


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket may go over the end of a batch."""
    held = None

    def solve(bucket: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch | None:
        edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        bounds = np.r_[0, edge, len(bucket)]
        size = np.diff(bounds)
        pairs = []
        two = bounds[:-1][size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        pairs += [np.stack([nodes[near], nodes[near + 1]])]
        for a, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist()):
            if links := list(spanning_links(fps[a:a + n], radius)):
                i, j = np.array(links).T + a
                pairs.append(np.stack([nodes[i], nodes[j]]))
        u, v = np.concatenate(pairs, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"]) if len(u) else None

    for batch in batches:
        bucket, fps, nodes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = [bucket, fps.view(np.uint64), nodes]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        if len(held[0]) < 2:
            continue
        last = np.flatnonzero(held[0] != held[0][-1])
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            if (out := solve(*(c[:cut] for c in held))) is not None:
                yield out
            held = [c[cut:] for c in held]
    if held and len(held[0]) and (out := solve(*held)) is not None:
        yield out


def simhash_groups(docs: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of every id: the component of fingerprints linked at ``radius`` bits or fewer.

    Equal fingerprints are one node from the start, so copies cost nothing further.  A bucket of more than ``block``
    distinct fingerprints is dealt over block pairs, each compared in a task of its own; per block pair only a
    spanning forest is returned.  A null, empty or wordless text has fingerprint 0 and is linked like any other.
    Rows that share an id stay apart; a null id comes before all others in ``component_id``'s order.
    Further columns are not read; an empty table gives no row.
    """
    rows = Keyed(docs)
    return rows.with_ids(_grouped(rows, radius, block), doc="doc_id", component="component_id")


def _grouped(rows: Keyed, radius: int, block: int) -> DataFrame:
    """(doc, fp, component) of every row key."""
    prints = stage(fingerprints(rows.texts), "simhash")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc").alias("node")), "simhash-nodes")
    masks = covering_masks(radius)
    # the table's number goes into the bucket's hash; equal hashes of different buckets only add comparisons
    keys = nodes.select("fp", "node", F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << BITS) if m >> BITS - 1 else m)))
        for k, m in enumerate(masks)])).alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / block)
    mine = F.pmod(F.xxhash64("fp"), blocks)
    dealt = keys.join(sizes, "bucket").withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        F.when(blocks == 1, F.col("bucket")).otherwise(
            F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).alias("bucket"), "fp", "node")
    edges = (dealt.repartition("bucket").sortWithinPartitions("bucket").select(
        "bucket", F.col("fp"), "node").mapInArrow(_with_radius(radius), "u long, v long"))
    found = components(edges)
    groups = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(groups, "fp").select("doc", "fp", "component")


def _with_radius(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _links(batches, radius):
            yield batch
    return run


def keep_one_per_group(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The first row of each near-duplicate group, in the order of the ids, nulls first; columns stay as they are."""
    rows = Keyed(docs)
    kept = _grouped(rows, radius, BLOCK).filter("doc = component").select(F.col("doc").alias(rows.key))
    return rows.table.join(kept, rows.key, "left_semi").select(*rows.columns)
