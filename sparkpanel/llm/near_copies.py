"""Near copies: covering SimHash of word shingles (operator 2) with a wider radius, checked by exact Jaccard similarity.

At a Jaccard similarity J two sets of equal size have a cosine of 2 J / (1 + J), so a SimHash bit of theirs differs with
probability acos(2 J / (1 + J)) / pi, 0.15 at 0.8; other sizes are closer.  That is up to 17 bits of 64, which one covering
meets with 2^18 masks only.  The fingerprint is therefore longer and has ``PARTS`` parts of ``WIDTH`` bits, each with the 15
covering masks of operator 2: a pair that differs in up to 4 * PARTS - 1 of these bits has a part within the radius and
always meets, and at 0.8 a pair meets in no mask with probability 3.5 in a million (sets of four and five shingles: 2
in ten thousand).  Where two texts meet, ``CHECK`` further bits and the sizes of the sets decide whether they are
candidates.  Candidates form groups, within which all pairs are decided on their full shingle sets.
"""
from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Keyed, stage, texts_of
from .components import components
from .simhash import covering_masks

PARTS, WIDTH, CHECK = 9, 20, 192
WORDS = -(-(PARTS * WIDTH + CHECK) // 64)
#: Steps of a set size's natural logarithm, and the bits that hold it behind a bucket's number.
STEPS, SIZE_BITS = 1 << 15, 20
#: Rows that are compared at once, buckets left whole.
ROWS = 1 << 16
#: Texts of a candidate group that are compared in one task; larger groups are dealt out in pairs of blocks.
BLOCK = 256
_factors = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
_mixer = np.uint64(0xD6E8FEB86659FD93)
_masks = np.array(covering_masks(bits=WIDTH), np.int64)


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, without a word there is none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size, joined = min(size, len(words)), b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[size - 1:]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())),
                                 np.uint64, len(ends)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of distinct shingles as ``WORDS`` words: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # 255 ones fit a byte
        h = hashes[at:at + 255]
        x = (h ^ h >> np.uint64(32))[:, None] * _factors
        x ^= x >> np.uint64(29)
        x *= _mixer
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def buckets(prints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per fingerprint one place for each mask of each part: the bucket's number, then the set's size on a logarithmic scale."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little", count=PARTS * WIDTH)
    parts = bits.reshape(-1, PARTS, WIDTH).astype(np.int64) @ (1 << np.arange(WIDTH, dtype=np.int64))
    masked = parts[:, :, None] & _masks
    masked |= np.arange(masked[0].size).reshape(masked[0].shape) << WIDTH
    step = np.floor(np.log(sizes) * STEPS).astype(np.int64)
    return masked.reshape(len(prints), -1) << SIZE_BITS | step[:, None]


def farthest(similarity: float) -> int:
    """The differing ``CHECK`` bits up to which texts are candidates, 5.8 standard deviations above the mean at that similarity."""
    p = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    return int(CHECK * p + 5.8 * sqrt(CHECK * p * (1 - p)))


def connected(place: np.ndarray, checks: np.ndarray, window: int, most: int) -> np.ndarray:
    """For each of the rows, sorted by place, the first row it is connected to by pairs at most ``window`` places and
    ``most`` bits apart.

    Row i meets row i + 1, then i + 2 and so on, all rows at once; rows already connected are not compared again.
    """
    root, at, step = np.arange(len(place)), np.arange(len(place)), 0
    first = checks[:, 0]
    while len(at):
        step += 1
        at = at[:np.searchsorted(at, len(place) - step)]
        at = at[place[at + step] - place[at] <= window]
        i = at[root[at] != root[at + step]]
        i = i[np.bitwise_count(first[i] ^ first[i + step]) <= most]
        i = i[np.bitwise_count(checks[i] ^ checks[i + step]).sum(1, dtype=np.int64) <= most]
        while len(i):
            a, b = root[i], root[i + step]
            root[np.maximum(a, b)] = np.minimum(a, b)
            while (root != (root := root[root])).any():
                pass
            i = i[root[i] != root[i + step]]
    return root


def similar_links(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Edges (i, j) that connect the sets exactly as all pairs of at least that Jaccard similarity do."""
    left = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    while len(left):
        seed, left = int(left[0]), left[1:]
        frontier = [seed]
        while frontier and len(left):
            mine = sets[frontier.pop()]
            near = np.zeros(len(left), bool)
            fits = np.flatnonzero(np.minimum(sizes[left], len(mine)) >= similarity * np.maximum(sizes[left], len(mine)))
            if len(fits):
                part = np.concatenate([sets[j] for j in left[fits].tolist()])
                at = np.minimum(np.searchsorted(mine, part), len(mine) - 1)
                common = np.add.reduceat((mine[at] == part).astype(np.int64), np.r_[0, np.cumsum(sizes[left[fits]])[:-1]])
                near[fits] = common >= similarity * (len(mine) + sizes[left[fits]] - common)
            found, left = left[near], left[~near]
            for j in found.tolist():
                yield seed, j
            frontier.extend(found.tolist())


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of every id: the component of texts linked at that Jaccard similarity or more.

    Texts with equal shingle sets are one node from the start; texts without a word are one group.  Rows that share an id
    stay apart; a null id comes before all others.  An empty table gives no row.
    """
    rows = Keyed(docs)
    return rows.with_ids(_grouped(rows, similarity, size, block), doc="doc_id", component="component_id")


def _grouped(rows: Keyed, similarity: float = 0.8, size: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc, component) of every row key."""
    texts = rows.texts
    checks = [f"check{k}" for k in range(CHECK // 64)]
    window, most = ceil(log(1 / similarity) * STEPS) + 1, farthest(similarity)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for batch in batches:
            sets = [shingles(t, size) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array(map(len, sets), pa.int64()), pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())],
                names=["doc", "same", "size", "print"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                prints = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(-1, WORDS)
                place = buckets(prints, part.column(1).to_numpy())
                rows = [place.ravel(), np.repeat(part.column(0).to_numpy(), place.shape[1]),
                        *np.repeat(prints[:, -(CHECK // 64):].T.view(np.int64), place.shape[1], axis=1)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, rows)), names=["place", "node", *checks])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by place.  The last rows of a block meet the first ones of the next."""
        def solved() -> tuple[pa.RecordBatch, list[np.ndarray]]:
            place, node, *words = map(np.concatenate, zip(*held))
            root = connected(place, np.stack(words, axis=1).view(np.uint64), window, most)
            low = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(low, root, node)
            low = low[root]
            more = low < node
            open_ = np.searchsorted(place, place[-1] - window)
            return (pa.RecordBatch.from_arrays([pa.array(node[more]), pa.array(low[more])], names=["u", "v"]),
                    [c[open_:].copy() for c in (place, node, *words)])

        held, rows, due = [], 0, ROWS
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= due:
                out, kept = solved()
                yield out
                held, rows = [kept], len(kept[0])
                due = max(ROWS, 2 * rows)
        if rows:
            yield solved()[0]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; a part may go over the end of a batch."""
        part, nodes, sets = None, [], []

        def solved() -> Iterator[pa.RecordBatch]:
            if pairs := list(similar_links(sets, similarity)):
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()),
                                                  pa.array([nodes[j] for _, j in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            for key, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch)):
                if key != part:
                    yield from solved()
                    part, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(shingles(text, size))
        yield from solved()

    sketches = stage(texts.select("doc", "text").mapInArrow(sketch, "doc long, same binary, size long, print binary"),
                     "near-copies")
    nodes = stage(sketches.groupBy("same").agg(F.min("doc").alias("node"), F.first("size").alias("size"),
                                               F.first("print").alias("print")), "near-copies-nodes")
    places = nodes.filter("size > 0").select("node", "size", "print").mapInArrow(
        placed, ", ".join(f"{c} long" for c in ("place", "node", *checks)))
    met = places.repartition(F.shiftright("place", SIZE_BITS)).sortWithinPartitions("place").mapInArrow(meet, "u long, v long")
    # a node has at most one lower node per mask; the lowest takes the node and the others, which many nodes share
    lower = met.groupBy("u").agg(F.collect_set("v").alias("all"))
    edges = lower.select("u", F.array_min("all").alias("low"), F.explode("all").alias("v")).select(
        F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
    maybe = stage(components(edges), "near-copies-candidates")
    blocks = F.ceil(F.col("size") / block)
    dealt = maybe.join(maybe.groupBy("component").agg(F.count("*").alias("size")), "component").withColumn(
        "mine", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"), "node")
    edges = dealt.join(texts, F.col("node") == F.col("doc")).select("part", "node", "text").repartition("part").sortWithinPartitions(
        "part").mapInArrow(links, "u long, v long")
    groups = nodes.select("same", "node").join(components(edges), "node", "left").select(
        "same", F.coalesce("component", "node").alias("component"))
    return sketches.select("doc", "same").join(groups, "same").select("doc", "component")


def keep_one_per_group(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The first row of each group of near copies, in the order of the ids, nulls first; columns stay as they are."""
    rows = Keyed(docs)
    kept = _grouped(rows, similarity).filter("doc = component").select(F.col("doc").alias(rows.key))
    return rows.table.join(kept, rows.key, "left_semi").select(*rows.columns)
