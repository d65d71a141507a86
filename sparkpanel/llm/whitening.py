"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries are scaled to integers, so the scatter matrix M = n * sum(x x^T) - S S^T, which is n^2 times the covariance, is exact.
Its characteristic polynomial is found modulo many primes, one Spark row each: similarity transforms bring M to Hessenberg form, whose
leading blocks give the polynomial by a recurrence.  Chinese remaindering joins the coefficients; a bound on them says
how many primes it takes.  All roots are real and none is negative, so the sign changes in the coefficients of p(y + a) count the
roots beyond a exactly, multiplicities included: bisection on that count isolates the k-th largest root, one Spark row per
component.  The component is the null space of M - root * I, by inverse iteration in decimal arithmetic of ``DIGITS`` digits.

Only sums over dimensions, d^2 integers, and the polynomial reach the driver; rows stay in Spark.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .vectors import finite, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Bits behind the point to which roots are isolated, relative to the largest possible root.
ROOT_BITS = 160
DIGITS = 90
#: Scaled entries beyond this size are held at it.
LIMIT = 1 << 52


def scaled(rows: DataFrame, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Rows with a sound vector and ``x``, its entries as longs."""
    whole = F.transform(vector_col, lambda c: (F.floor(F.greatest(F.least(
        c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))) + shift).cast("long"))
    return rows.filter(finite(vector_col) & (F.size(vector_col) > 0)).withColumn("x", whole)


def exact_gram(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(sums, sums of products) of integer rows as Python integers.

    Products run in floating point in slices that stay below 2^53, where it is exact, else in integers of any size.
    """
    d = x.shape[1]
    top = int(np.abs(x).max(initial=0))
    sums = [int(s) for s in (x.sum(0) if top * max(len(x), 1) < 1 << 62 else x.astype(object).sum(0))]
    step = (1 << 53) // max(top * top, 1)
    total = np.zeros((d, d), object)
    if step >= 16:
        for at in range(0, len(x), min(step, 1 << 16)):
            part = x[at:at + min(step, 1 << 16)].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
    else:
        wide = x.astype(object)
        total += wide.T @ wide
    return sums, total.tolist()


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, sum of x x^T) over the fit list, exact; tasks reduce their rows first and Spark adds up the d * (d + 3) / 2 sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = matrix(batch.column(0), width, np.int64) - SHIFT
            s, g = exact_gram(x)
            n, sums, total = n + len(x), sums + np.array(s, object), total + np.array(g, object)
        if n:
            values = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums.tolist())),
                      *((i, j, int(total[i, j])) for i in range(width) for j in range(i + 1))]
            # in two parts, so that sums of large products fit a decimal
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[0] for v in values], pa.int32()), pa.array([v[1] for v in values], pa.int32()),
                 pa.array([Decimal(v[2] >> 60) for v in values], pa.decimal128(38, 0)),
                 pa.array([v[2] & ((1 << 60) - 1) for v in values], pa.int64())], names=["i", "j", "high", "low"])

    found = fit.select("x").mapInArrow(run, "i int, j int, high decimal(38,0), low long").groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    value = {(r.i, r.j): (int(r.high) << 60) + int(r.low) for r in found}
    n = value.get((-1, -1), 0)
    sums = [value.get((i, -1), 0) for i in range(width)]
    return n, sums, [[value.get((max(i, j), min(i, j)), 0) for j in range(width)] for i in range(width)]


def scatter(n: int, sums: list[int], gram: list[list[int]]) -> list[list[int]]:
    return [[n * g - a * b for g, b in zip(row, sums)] for row, a in zip(gram, sums)]


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest ``count`` primes below 2^31, so that products fit 62 bits."""
    small = np.flatnonzero(_sieve(isqrt(below) + 1))
    found: list[int] = []
    high = below
    while len(found) < count:
        low = high - (1 << 18)
        sound = np.ones(1 << 18, bool)
        for p in small.tolist():
            sound[-low % p::p] = False
        found += (np.flatnonzero(sound)[::-1] + low).tolist()
        high = low
    return found[:count]


def _sieve(size: int) -> np.ndarray:
    sound = np.ones(size, bool)
    sound[:2] = False
    for i in range(2, isqrt(size) + 1):
        if sound[i]:
            sound[i * i::i] = False
    return sound


def charpoly_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of det(y I - m) modulo the prime ``p``."""
    h, d = m.astype(np.int64) % p, len(m)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        if (pivot := int(below[0]) + k) != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        # rows lose factor times row k; in return column k gains the columns times factor
        h[k + 1:] = (h[k + 1:] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * factor % p).sum(1)) % p
    # p_k = (y - h_kk) p_(k-1) - sum over i of h_ik * (product of the subdiagonal from i to k) * p_(i-1)
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k, :-1]
        new = (new - int(h[k, k]) * polys[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            new = (new - int(h[i, k]) * chain % p * polys[i] % p) % p
        polys[k + 1] = new
    return polys[d].tolist()


def coefficient_bound(m: list[list[int]]) -> int:
    """No coefficient is larger: the roots are not negative and add up to the trace t, so their k-th symmetric sum is at
    most C(d, k) (t / d)^k."""
    d = len(m)
    mean = sum(m[i][i] for i in range(d)) // d + 1
    return max(comb(d, k) * mean ** k for k in range(d + 1))


def _on_rows(spark, numbers: int, parts: int, run, schema: str):
    return spark.range(0, numbers, 1, max(1, min(numbers, parts))).mapInPandas(run, schema)


def charpoly(spark, m: list[list[int]]) -> list[int]:
    """Integer coefficients, lowest first, of det(y I - m): a row per prime, joined by Chinese remaindering."""
    d = len(m)
    # primes have over 30 bits; one bit is for the sign
    moduli = primes((coefficient_bound(m).bit_length() + 1) // 30 + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"].tolist():
                p = moduli[k]
                reduced = np.array([[v % p for v in row] for row in m], np.int64)
                yield pd.DataFrame({"p": [p], "coefficients": [charpoly_mod(reduced, p)]})

    rows = _on_rows(spark, len(moduli), spark.sparkContext.defaultParallelism, run, "p long, coefficients array<long>").collect()
    product, values = 1, [0] * (d + 1)
    for r in sorted(rows, key=lambda r: -r.p):
        inverse = pow(product, -1, r.p)
        values = [v + product * ((c - v) * inverse % r.p) for v, c in zip(values, r.coefficients)]
        product *= r.p
    return [v - product if 2 * v > product else v for v in values]


def beyond(poly: list[int], at: int) -> int:
    """Roots larger than the integer ``at`` of a polynomial whose roots are all real, with multiplicity."""
    c = poly[:]
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int, limit: int) -> tuple[int, int, int]:
    """(low, above, inside): the k-th largest root lies in (low, low + 1]; ``above`` roots are larger, ``inside`` lie there.

    Once a single root is left between the bounds, the sign of the polynomial, which is cheaper, replaces the count.
    """
    low, high = -1, limit
    upto, above = beyond(poly, low), 0  # roots beyond low and beyond high
    while high - low > 1 and upto - above > 1:
        mid = low + high >> 1
        n = beyond(poly, mid)
        if n >= k:
            low, upto = mid, n
        else:
            high, above = mid, n
    if high - low > 1:
        top = _sign(poly, high)
        while top and high - low > 1:
            mid = low + high >> 1
            now = _sign(poly, mid)
            low, high = (low, mid) if now in (0, top) else (mid, high)
        if not top:
            low = high - 1
    return low, above, upto - above


def _sign(poly: list[int], at: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return (value > 0) - (value < 0)


def null_space(m: list[list[int]], root: Decimal, inside: int, rounds: int = 3) -> np.ndarray:
    """``inside`` orthonormal vectors that M - root * I all but annuls, as columns: block inverse iteration on an LU
    decomposition with partial pivots.  Starting columns are fixed, so every task finds the same block."""
    d = len(m)
    a = np.array([[Decimal(v) for v in row] for row in m], object)
    a[np.arange(d), np.arange(d)] -= root
    tiny = max(max(abs(Decimal(v)) for row in m for v in row), Decimal(1)).scaleb(-DIGITS)
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:])
    block = np.array([[Decimal((i * (j + 2) * 7919 + j * 104729) % 1009 - 504) for j in range(inside)] for i in range(d)], object)
    for _ in range(rounds):
        block = block[order]
        for k in range(d):
            block[k] -= a[k, :k] @ block[:k] if k else 0
        for k in range(d - 1, -1, -1):
            block[k] = (block[k] - (a[k, k + 1:] @ block[k + 1:] if k + 1 < d else 0)) / a[k, k]
        for j in range(inside):
            column = block[:, j] / max(abs(v) for v in block[:, j])
            for other in block[:, :j].T:
                column = column - other * (other @ column)
            block[:, j] = column / (column @ column).sqrt()
    return block


def components_of(spark, m: list[list[int]], poly: list[int], count: int) -> list[tuple[Fraction, list[float]]]:
    """(root of M, unit vector with its largest entry positive) of the ``count`` largest roots; a root of 0 has no vector."""
    d = len(m)
    zeros = next(i for i, c in enumerate(poly) if c)
    trace = sum(m[i][i] for i in range(d))
    bits = max(0, ROOT_BITS - trace.bit_length())
    # y = 2^bits * root has whole bounds
    fine = [c << bits * (d - i) for i, c in enumerate(poly)]
    limit = (trace + 1) << bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in frame["id"].tolist():
                low, above, inside = isolate(fine, k + 1, limit)
                with localcontext() as context:
                    context.prec = DIGITS
                    block = null_space(m, Decimal(low) / Decimal(1 << bits) + Decimal(1) / Decimal(2 << bits), inside)
                    vector = block[:, k - above]
                    if max(vector, key=abs) < 0:
                        vector = -vector
                    yield pd.DataFrame({"k": [k], "low": [str(low)], "vector": [[float(v) for v in vector]]})

    # a root of 0 is known from the polynomial alone
    positive = min(count, d - zeros)
    if not positive:
        return []
    rows = _on_rows(spark, positive, positive, run, "k int, low string, vector array<double>").collect()
    return [(Fraction(2 * int(r.low) + 1, 2 << bits), r.vector) for r in sorted(rows, key=lambda r: r.k)]


def whitening(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound row and component.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry are left out, like those of another
    length than the most frequent one (ties: the longest).  The model is fitted on each distinct integer vector once.  There are up to
    ``count`` components; where the eigenvalue is exactly 0 (fewer distinct vectors than dimensions, or equal entries)
    ``whitened`` is null, ``explained`` 0 and the component is left out of ``identity_error``, which is null if none is left; without
    any variance ``explained`` is null.  ``deviation`` is null where it exceeds a long.  Entries beyond 2^52 / 64 are
    held there.  Rows that share an id and null ids each keep their own rows; further columns are not read; an empty table gives no row.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sound = scaled(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")), "vector")
    usual = sound.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    width = usual.width
    sound = sound.filter(F.size("x") == width).select("vec_id", "x")
    fit = stage(sound.select("x").distinct(), "whitening-fit")
    n, sums, gram = moments(fit, width)
    m = scatter(n, sums, gram)
    trace = sum(m[i][i] for i in range(width))
    count = min(count, width)
    found = components_of(spark, m, charpoly(spark, m), count) if trace else []
    vectors = np.array([v for _, v in found]).reshape(len(found), width).T
    roots = np.array([float(r / n ** 2) for r, _ in found])
    explained = [float(r / trace) for r, _ in found] + [0.0 if trace else None] * (count - len(found))

    def centred(x: np.ndarray) -> np.ndarray:
        """n * (x - mean), in integers; both sides are less the shift."""
        x = x - SHIFT
        small = int(np.abs(x).max(initial=0)) * n < 1 << 61 and max(map(abs, sums)) < 1 << 61
        return x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)

    def projected(c: np.ndarray) -> np.ndarray:
        return (c / n).astype(np.float64) @ vectors / np.sqrt(roots)

    error = identity_error(fit, lambda x: projected(centred(x)), width, len(found)) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = centred(matrix(batch.column(1), width, np.int64))
            size = len(c)
            wide = c.astype(object) if int(np.abs(c).max(initial=0)) ** 2 * width >= 1 << 63 else c
            deviation = [v if v < 1 << 63 else None for v in (wide * wide).sum(1).tolist()]
            white = np.concatenate([projected(c), np.full((size, count - len(found)), np.nan)], axis=1).ravel()
            known = np.tile(np.arange(count) < len(found), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(size), count))), pa.array(np.tile(np.arange(1, count + 1), size), pa.int32()),
                 pa.array(np.full(size * count, n), pa.int64()), pa.array([v for v in deviation for _ in range(count)], pa.int64()),
                 pa.array(white, pa.float64(), mask=~known), pa.array(explained * size, pa.float64()),
                 pa.array([error] * size * count, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return sound.mapInArrow(run, schema)


def identity_error(fit: DataFrame, whiten, width: int, count: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity; products are of centred values."""
    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = whiten(matrix(batch.column(0), width, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(count), pa.int32()), pa.array(w.sum(0)),
                                              pa.array(np.full(count, len(w)), pa.int64())], names=["i", "s", "n"])

    rows = fit.mapInArrow(means, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean")).collect()
    mean = np.array([r["mean"] for r in sorted(rows, key=lambda r: r.i)])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = whiten(matrix(batch.column(0), width, np.int64)) - mean
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(count * count), pa.int32()), pa.array((w.T @ w).ravel()),
                                              pa.array(np.full(count * count, len(w)), pa.int64())], names=["i", "s", "n"])

    off = F.abs(F.sum("s") / F.sum("n") - F.when(F.col("i") % (count + 1) == 0, 1.0).otherwise(0.0))
    return fit.mapInArrow(products, "i int, s double, n long").groupBy("i").agg(off.alias("off")).agg(F.max("off")).first()[0]
