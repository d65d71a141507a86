from decimal import localcontext
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from sparkpanel.llm import vectors, whitening as w
from sparkpanel.llm.queries import QUERIES

from llm.conftest import SMALL

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType()))])


def plain(rows):
    """Integer vectors of the sound rows, and the fit list, by numpy."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], object)
    return x, np.array(sorted(set(map(tuple, x.tolist()))), object)


def check(rows, got, tolerance=1e-9):
    x, fit = plain(rows)
    n, d = fit.shape
    sums = fit.sum(0)
    centred = np.array([[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(row, sums)] for row in fit])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vecs = values[order], vecs[:, order]
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(table) == sorted(i for i, _ in rows)
    count = min(16, d)
    for (i, _), row in zip(rows, x):
        assert sorted(table[i]) == list(range(1, count + 1))
        exact = sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))
        assert table[i][1].n == n and table[i][1].deviation == (exact if exact < 1 << 63 else None)
    for k in range(1, count + 1):
        assert abs(table[rows[0][0]][k].explained - values[k - 1] / values.sum()) < 1e-9
        near = min(abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1) if d > 1 else 1
        if values[k - 1] > 1e-9 * values[0] and near > 1e-3 * values[k - 1]:
            want = np.array([[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(row, sums)] for row in x]) @ vecs[:, k - 1]
            want /= np.sqrt(values[k - 1])
            mine = np.array([table[i][k].whitened for i, _ in rows])
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < tolerance * (1 + np.abs(want).max()) * 1e3
    return table


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in vectors.embeddings(spark, SMALL).collect()]
    got = QUERIES["op12_whitening"](spark, SMALL).collect()
    check(rows, got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_characteristic_polynomial(spark):
    """Equal to the polynomial by the exact recurrence of Faddeev and Leverrier, singular and repeated roots included."""
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 2), (5, 3), (9, 9)):
        x = rng.integers(-10**6, 10**6, (rank, d)).astype(object)
        m = (x.T @ x).tolist()
        a, power, coefficients = np.array(m, object), np.eye(d, dtype=int).astype(object), [1]
        for k in range(1, d + 1):
            power = a @ power
            c = -sum(power[i, i] for i in range(d)) // k
            coefficients.append(c)
            power = power + c * np.eye(d, dtype=int).astype(object)
        assert w.charpoly(spark, m) == coefficients[::-1]
    zero = [[0, 1, 0], [1, 0, 0], [0, 0, 5]]
    assert w.charpoly_mod(np.array(zero), 2**31 - 1) == [5, 2**31 - 2, 2**31 - 6, 1]


def test_roots_are_isolated():
    roots = [0, 0, 3, 7, 7, 7, 100, 10**12, 10**12 + 1]
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    for at in (-1, 0, 2, 3, 6, 7, 8, 10**12, 10**12 + 1):
        assert w.beyond(poly, at) == sum(r > at for r in roots)
    for k, want in enumerate(sorted(roots, reverse=True), 1):
        low, above, inside = w.isolate(poly, k, 10**13)
        assert low + 1 == want and above == sum(r > want for r in roots) and inside == roots.count(want)


def test_null_space_of_a_repeated_root():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    with localcontext() as c:
        c.prec = w.DIGITS
        block = w.null_space([[5 if i == j else 0 for j in range(4)] for i in range(4)], w.Decimal(5) + w.Decimal(10) ** -40, 4).astype(float)
    assert np.allclose(block.T @ block, np.eye(4))


def test_wide_entries_and_few_vectors(spark):
    """Large entries leave 64 bits; fewer vectors than dimensions have roots of exactly 0."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(3) * 3e8).tolist()) for i in range(40)]
    check(rows, w.whitening(spark.createDataFrame(rows, SCHEMA)).collect())
    rows = [(i, (rng.standard_normal(6) * 2).tolist()) for i in range(4)]
    table = check(rows, w.whitening(spark.createDataFrame(rows, SCHEMA)).collect())
    assert all((table[0][k].whitened is None) == (k > 3) and (table[0][k].explained == 0) == (k > 3) for k in range(1, 7))
    # equal variances: any basis of the plane, but the same one for all rows
    square = [(1, [1.0, 1.0]), (2, [-1.0, 1.0]), (3, [1.0, -1.0]), (4, [-1.0, -1.0]), (5, [1.0, 1.0])]
    got = w.whitening(spark.createDataFrame(square, SCHEMA)).collect()
    assert len(got) == 10 and all(r.n == 4 and abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-12 for r in got)
    by = {i: np.array([r.whitened for r in sorted(got, key=lambda r: r.component) if r.vec_id == i]) for i, _ in square}
    assert np.allclose(by[1], by[5]) and np.allclose(by[1], -by[4]) and abs(by[1] @ by[1] - 2) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (None, [0.25, 3.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]),
            (7, [1.0, inf]), (8, [1.0]), (9, [1e300, 1.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "component", "n", "width", "vector", "label")})
    got = w.whitening(table).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component) for r in got) == sorted(
        (i, k) for i in (1, 1, -1, -1, 9) for k in (1, 2))
    assert all(r.n == 4 for r in got) and all(r.deviation is None for r in got if r.vec_id == 9)
    same = w.whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, None, None)] * 4
    assert w.whitening(spark.createDataFrame([], SCHEMA)).count() == 0
