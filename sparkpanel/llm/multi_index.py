"""Embedding near-duplicates with an inverted multi-index.

Unit vectors are cut in two halves; each half has a codebook of its own, and the pairs of code words are the cells of a product
grid, many more than either codebook has words.  A vector lies in the cell of its nearest two code words.  Multi-sequence
traversal visits cells in rising order of the sum of both squared distances: a heap holds, for the halves' code words
sorted by distance, the next pairs of places.  A traversal ends where the sum exceeds the home cell's by the excess that holds
the target share of neighbours.  That excess is measured on a sample: at the threshold itself, the hardest case,
in random directions and in directions towards other vectors, and on the pairs that the sample holds.

A vector visits its home cell and those before it in the order of cells, so each pair meets in one cell only:
links are counted per cell and summed, no pair is ever written.  Every meeting is decided by the exact cosine.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Keyed, stage
from .components import components
from .vectors import finite, matrix, unit_rows

#: Vectors that the index is fitted on, at most about this many; every vector is indexed.
SAMPLE = 32768
#: Code words per half at most; up to there their number follows the largest label, for OCCUPANCY vectors a cell.
MAX_CODES, OCCUPANCY = 512, 64
#: Vectors of a cell, and visitors, that meet in one task; larger cells are dealt out in blocks.
BLOCK = 2048
SIMILARITY, TARGET = 0.98, 0.9995


@dataclass(frozen=True)
class MultiIndex:
    width: int
    first: np.ndarray
    second: np.ndarray
    excess: float

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its code words, less the half's own squared length."""
        half = self.width // 2
        return tuple((c * c).sum(1) - 2 * part @ c.T
                     for part, c in ((unit[:, :half], self.first), (unit[:, half:], self.second)))

    def homes(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, unit: np.ndarray) -> Iterator[list[int]]:
        """The cells of each row's traversal, nearest first."""
        for a, b in zip(*self.distances(unit)):
            yield [cell for cell, _ in self.traversal(a, b)]

    def traversal(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, float]]:
        """(cell, excess over the nearest cell) in rising order, up to ``excess``."""
        one, two = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b, one, two = a[one].tolist(), b[two].tolist(), one.tolist(), two.tolist()
        least, codes = a[0] + b[0], len(two)
        heap, seen = [(0.0, 0, 0)], {(0, 0)}
        while heap:
            over, i, j = heapq.heappop(heap)
            if over > self.excess:
                return
            yield one[i] * codes + two[j], over
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(one) and y < codes and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[x] + b[y] - least, x, y))


def codebook(points: np.ndarray, codes: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Lloyd's rounds from distinct random points; a code word without points keeps its place."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    words = distinct[rng.permutation(len(distinct))[:codes]]
    for _ in range(rounds):
        near = ((words * words).sum(1) - 2 * points @ words.T).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(words))[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


def at_similarity(unit: np.ndarray, towards: np.ndarray, similarity: float) -> np.ndarray:
    """Unit vectors at exactly that cosine from ``unit``, in the plane of ``towards``."""
    across = towards - (towards * unit).sum(1, keepdims=True) * unit
    return similarity * unit + np.sqrt(1 - similarity ** 2) * unit_rows(across)


def fit(sample: np.ndarray, codes: int, similarity: float, target: float, seed: int = 11) -> MultiIndex:
    """Codebooks and excess from a bounded sample of unit vectors."""
    rng, half = np.random.default_rng(seed), sample.shape[1] // 2
    index = MultiIndex(sample.shape[1], codebook(sample[:, :half], codes), codebook(sample[:, half:], codes), 0.0)
    some = sample[rng.permutation(len(sample))[:8192]]
    starts = np.concatenate([some] * 3)
    others = np.concatenate([rng.standard_normal((2 * len(some), sample.shape[1])), sample[rng.integers(0, len(sample), len(some))]])
    ends = at_similarity(starts, others, similarity)
    # true pairs of the sample, both ways; of a group of copies each has its nearest to the threshold
    few = some[:4096]
    cosines = few @ few.T
    np.fill_diagonal(cosines, -1)
    cosines[cosines < similarity] = 2
    near = np.flatnonzero(cosines.min(1) < 2)
    pairs = [(starts, ends)] + ([(few[near], few[cosines[near].argmin(1)])] if len(near) else [])
    reach = 0.0
    for x, y in pairs:
        a, b = index.distances(x)
        home = index.homes(y)
        rows = np.arange(len(x))
        over = a[rows, home // len(index.second)] + b[rows, home % len(index.second)] - a.min(1) - b.min(1)
        reach = max(reach, float(np.quantile(over, target, method="higher")))
    return MultiIndex(index.width, index.first, index.second, reach + 1e-9)


def meet(visitors: np.ndarray, members: np.ndarray, own: np.ndarray, ids_v: np.ndarray, ids_m: np.ndarray, copies_v: np.ndarray,
         copies_m: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of visitors, links of members, edge ends u, edge ends v) of one cell.

    ``own`` marks visitors at home: each pair of members counts once, by the larger id.  Edges are a spanning forest.
    """
    linked = visitors @ members.T >= similarity
    linked &= ~own[:, None] | (ids_v[:, None] > ids_m[None, :])
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    none = np.zeros(0, np.int64)
    n_v, n_m = np.zeros(len(ids_v), np.int64), np.zeros(len(ids_m), np.int64)
    if not len(rows):
        return n_v, n_m, none, none
    linked = linked[np.ix_(rows, cols)]
    n_v[rows], n_m[cols] = linked @ copies_m[cols], copies_v[rows] @ linked
    names, where = np.unique(np.r_[ids_v[rows], ids_m[cols]], return_inverse=True)
    at_v, at_m = where[:len(rows)], where[len(rows):]
    low, far = np.arange(len(names)), len(names)
    while True:
        before = low.copy()
        np.minimum.at(low, at_v, np.where(linked, low[at_m][None, :], far).min(1))
        np.minimum.at(low, at_m, np.where(linked, low[at_v][:, None], far).min(0))
        if (low == before).all():
            break
    moved = np.flatnonzero(low != np.arange(len(names)))
    return n_v, n_m, names[moved], names[low[moved]]


def near_vectors(rows: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK, occupancy: int = OCCUPANCY,
                 sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows are compared if their labels are equal and known and their vectors equally long; linked if the cosine is
    ``similarity`` or more.  Vectors that are null, empty, zero or hold a null, NaN or infinite entry link with nothing, like rows
    without a label.  Equal vectors of a label are one node of the index and linked with each other.  Rows that share
    an id stay apart; a null id comes before all others.  Further columns are not read; an empty table gives no row.
    """
    keyed = Keyed(rows.select(id_col, vector_col, label_col), id_col, vector_col)
    label, vector = F.col(label_col), F.col(vector_col)
    sound = label.isNotNull() & finite(vector_col) & F.exists(vector_col, lambda x: x != 0)
    # two hashes of 64 bits name label and vector; unsound rows are nodes of their own
    base = stage(keyed.table.select(
        F.col(keyed.key).alias("row"), F.coalesce(sound, F.lit(False)).alias("sound"), F.size(vector).alias("size"),
        *[F.xxhash64(F.lit(k), label.cast("string"), F.size(vector)).alias(f"l{k}") for k in (1, 2)],
        *[F.xxhash64(F.lit(k), label.cast("string"), vector).alias(f"h{k}") for k in (1, 2)], vector.alias("vector")), "vectors")
    texts = base.filter("sound").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("copies"))
    named = stage(base.filter("sound").select("row", "h1", "h2").join(texts, ["h1", "h2"]).select("row", "node", "copies"), "vector-nodes")
    nodes = stage(base.join(named.filter("row = node").select("row", "copies"), "row").select(
        F.col("row").alias("node"), "copies", "l1", "l2", "size", "vector"), "vector-texts")
    met = _meetings(nodes, similarity, target, block, occupancy, sample)
    if met is None:
        links, groups = nodes.select("node", F.lit(0).cast("long").alias("links")).limit(0), nodes.select("node", F.col("node").alias("component")).limit(0)
    else:
        links = met.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
        groups = components(met.filter("v is not null").select("u", "v"))
    per_node = named.select("node", "copies").distinct().join(links, "node", "left").join(groups, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"))
    found = base.select("row").join(named.select("row", "node").join(per_node, "node"), "row", "left").select(
        F.col("row").alias("doc"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "row").alias("component_id"))
    return keyed.with_ids(found, doc="vec_id", component_id="component_id").withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _meetings(nodes: DataFrame, similarity: float, target: float, block: int, occupancy: int, sample: int) -> DataFrame | None:
    """(u, v, links): partial link counts of nodes where v is null, else edges that connect what is linked."""
    spans = nodes.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.max("size").alias("size")).agg(
        F.sum("n"), F.max("n"), F.max("size")).first()
    if spans[0] is None:
        return None
    total, largest, width = spans[0], spans[1], max(spans[2] + spans[2] % 2, 2)
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample / total)))
    drawn = nodes.filter(share).select("vector").toArrow().column("vector")
    if not len(drawn):
        drawn = nodes.select("vector").limit(1).toArrow().column("vector")
    points = unit_rows(matrix(drawn, width))
    codes = int(np.clip(np.sqrt(largest / occupancy), 1, min(MAX_CODES, max(1, len(points) // 16))))
    index = fit(points, codes, similarity, target)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(matrix(batch.column(1), width))
            at, cell, home = [], [], []
            for i, visited in enumerate(index.visits(unit)):
                own = visited[0]
                # a pair in two cells meets in the lower one
                mine = [own, *(c for c in visited[1:] if c < own)]
                at += [i] * (len(mine) + 1)
                cell += [own, *mine]
                home += [2, 1] + [0] * (len(mine) - 1)
            keys = batch.column(0).to_numpy()[np.array(at, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cell, pa.int64()), pa.array(home, pa.int32())],
                                             names=["node", "cell", "role"])

    # role: 2 a member of the cell, 1 the same vector as a visitor at home, 0 a visitor from another cell
    entries = stage(nodes.select("node", "vector").mapInArrow(cells, "node long, cell long, role int").join(
        nodes.select("node", "l1", "l2"), "node"), "multi-index")
    cell = ["l1", "l2", "cell"]
    sizes = entries.groupBy(*cell).agg(F.sum((F.col("role") == 2).cast("long")).alias("members"),
                                       F.sum((F.col("role") != 2).cast("long")).alias("visitors")).filter(
        "members > 0 and visitors > 1").select(*cell, F.ceil(F.col("members") / block).alias("m"), F.ceil(F.col("visitors") / block).alias("v"))
    is_member = F.col("role") == 2
    mine = F.pmod(F.xxhash64("node"), F.when(is_member, F.col("m")).otherwise(F.col("v")))
    dealt = entries.join(sizes, cell).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_member, F.col("v")).otherwise(F.col("m")) - 1))).select(
        *cell, F.when(is_member, F.col("mine")).otherwise(F.col("other")).alias("a"),
        F.when(is_member, F.col("other")).otherwise(F.col("mine")).alias("b"), "role", "node")
    order = [*cell, "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and block; one may go over the end of a batch."""
        held: list[pa.Table] = []
        now = None

        def solved() -> Iterator[pa.RecordBatch]:
            part = pa.concat_tables(held).combine_chunks() if held else None
            if part is None or len(part) < 2:
                return
            role, ids, copies = (part.column(c).to_numpy() for c in ("role", "node", "copies"))
            unit = unit_rows(matrix(part.column("vector"), width))
            m, v = role == 2, role != 2
            n_v, n_m, left, right = meet(unit[v], unit[m], role[v] == 1, ids[v], ids[m], copies[v], copies[m], similarity)
            u = np.r_[ids[v][n_v > 0], ids[m][n_m > 0]]
            if len(u):
                links = np.r_[n_v[n_v > 0], n_m[n_m > 0], np.zeros(len(left), np.int64)]
                ends = pa.array(np.r_[np.zeros(len(u), np.int64), right], mask=np.r_[np.ones(len(u), bool), np.zeros(len(left), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[u, left]), ends, pa.array(links)], names=["u", "v", "links"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if now is None or (keys[a] != now).any():
                    yield from solved()
                    held, now = [], keys[a]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        yield from solved()

    return stage(dealt.join(nodes.select("node", "copies", "vector"), "node").select(*order, "role", "node", "copies", "vector")
                 .repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "u long, v long, links long"), "multi-index-links")
