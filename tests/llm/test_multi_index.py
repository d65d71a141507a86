import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from sparkpanel.llm import multi_index, vectors
from sparkpanel.llm.queries import QUERIES, SQL

from llm.conftest import SMALL

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())])


def brute_force(rows, similarity=0.98):
    """[(row place, n_links, smallest place reachable)], rows given in the order of their keys."""
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    near = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None and rows[i][2] is not None
             and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= similarity]
            for i in range(len(rows))]
    low = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            for j in js:
                if low[j] < low[i]:
                    low[i], changed = low[j], True
    return [(len(js), low[i]) for i, js in enumerate(near)]


def clustered(seed=1, groups=40, width=16, labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(width)
        for _ in range(int(rng.integers(1, 30))):
            v = centre + rng.standard_normal(width) * 0.08 * np.linalg.norm(centre) / 4 * rng.random() * 2
            rows.append((0, v.astype(np.float32).tolist(), g % labels))
    order = rng.permutation(len(rows))
    return [(i * 2, *rows[k][1:]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block,occupancy", [(2048, 4), (7, 4), (2048, 10**6)])
def test_against_all_pairs(spark, block, occupancy):
    rows = clustered()
    got = {r.vec_id: r for r in multi_index.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block, occupancy=occupancy).collect()}
    want = brute_force(rows)
    assert len(got) == len(rows) and sum(n for n, _ in want) > 100
    found, true = sum(r.n_links for r in got.values()), sum(n for n, _ in want)
    assert 0.99 * true <= found <= true
    if block == 2048 and occupancy == 10**6:  # one cell: nothing can be missed
        assert [(got[i].n_links, got[i].component_id) for i, *_ in rows] == [(n, rows[low][0]) for n, low in want]


def test_recall_on_the_table(spark):
    table = vectors.embeddings(spark, SMALL)
    rows = sorted(map(tuple, table.collect()))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op11_multi_index"](spark, SMALL).collect()}
    assert got == {rows[i][0]: (n, rows[low][0], low == i) for i, (n, low) in enumerate(brute_force(rows))}


def test_target_recall_of_the_traversal():
    """Neighbours at the threshold itself, in directions that the index was not fitted on."""
    rng = np.random.default_rng(4)
    unit = vectors.unit_rows(rng.standard_normal((6000, 32)))
    index = multi_index.fit(unit[:3000], 12, 0.98, 0.99)
    near = multi_index.at_similarity(unit[3000:], rng.standard_normal((3000, 32)), 0.98)
    visits = list(index.visits(unit[3000:]))
    assert np.mean([h in v for h, v in zip(index.homes(near).tolist(), visits)]) > 0.97
    assert np.mean([len(v) for v in visits]) < 0.6 * 144
    a, b = index.distances(unit[:50])
    for x, y in zip(a, b):
        steps = [o for _, o in index.traversal(x, y)]
        every = np.sort((x[:, None] + y[None, :]).ravel() - x.min() - y.min())
        assert np.allclose(steps, every[:len(steps)], atol=1e-12) and steps == sorted(steps)
        assert len(steps) == (every <= index.excess).sum()


ODD = [(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None),
       (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 0.0], 1), (10, [float("nan"), 1.0, 0.0], 1),
       (11, [float("inf"), 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1.0, 0.0], 1), (14, [1.0, 0.1, 0.0], 1),
       (14, [1.0, 0.1, 0.0], 1), (14, [0.0, 1.0, 0.0], 1), (None, [0.0, 3.0, 0.0], 1), (None, [0.0, 0.0, 1.0], 2), (20, [3e38, 3e38, 0.0], 1),
       (21, [1e-38, 1e-38, 0.0], 1), (22, [-1.0, 0.0, 0.0], 1)]


def test_odd_vectors(spark):
    """Each row keeps apart; unsound vectors link with nothing; unequal lengths are not compared."""
    for kind in (FloatType(), DoubleType()):
        table = spark.createDataFrame(ODD, StructType([SCHEMA[0], StructField("embedding", ArrayType(kind)), SCHEMA[2]])).withColumns(
            {c: F.lit("x") for c in ("row", "node", "row_key", "h1", "sound", "vector", "doc")})
        got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id)
                     for r in multi_index.near_vectors(table).collect())
        rows = sorted(ODD, key=lambda r: -1 if r[0] is None else r[0])
        want = sorted((-1 if rows[i][0] is None else rows[i][0], n, -1 if rows[low][0] is None else rows[low][0])
                      for i, (n, low) in enumerate(brute_force(rows)))
        assert got == want
    only = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert [tuple(r) for r in multi_index.near_vectors(only).collect()] == [(1, 0, 1, True)]
    assert multi_index.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = con.execute(SQL["op11_multi_index"]).fetchdf().sort_values("vec_id").reset_index(drop=True)
    got = QUERIES["op11_multi_index"](spark, SMALL).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and (got == want).all().all()
