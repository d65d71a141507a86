import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import isotonic


def by_definition(x, y):
    """{x: fit} as the largest of the smallest means over all intervals around x."""
    xs = np.unique(x)
    s = np.array([y[x == v].sum() for v in xs])
    w = np.array([(x == v).sum() for v in xs], float)
    cs, cw = np.r_[0, s.cumsum()], np.r_[0, w.cumsum()]
    n = len(xs)
    fit = np.full(n, -np.inf)
    for a in range(n):
        means = (cs[a + 1:] - cs[a]) / (cw[a + 1:] - cw[a])
        lowest = np.minimum.accumulate(means[::-1])[::-1]
        fit[a:] = np.maximum(fit[a:], lowest)
    return dict(zip(xs.tolist(), fit.tolist()))


def table(spark, x, y, parts=6):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(parts)


CASES = {
    "noise": lambda r: (r.integers(0, 300, 900), r.standard_normal(900)),
    "rising noise": lambda r: (v := r.random(600), v + r.standard_normal(600) * 0.3),
    "monotone": lambda r: (np.arange(400), np.arange(400)),
    "falling": lambda r: (np.arange(400), -np.arange(400.0)),
    "late drop": lambda r: (np.arange(400), np.r_[np.arange(399.0), -1e6]),
    "early peak": lambda r: (np.arange(400), np.r_[1e6, np.arange(399.0)]),
    "ties": lambda r: (r.integers(0, 4, 50), r.integers(0, 2, 50)),
    "one": lambda r: (np.ones(3), np.array([1.0, 2, 6])),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("ends", [2, 4096])
def test_fit_is_the_definition(spark, name, ends):
    x, y = CASES[name](np.random.default_rng(len(name)))
    x, y = np.asarray(x, float), np.asarray(y, float)
    knots = isotonic.isotonic_knots(table(spark, x, y), "x", "y", ends, 8 if ends == 2 else 1 << 20)
    want = by_definition(x, y)
    got = {r.x: r.p for r in isotonic.read_curve(table(spark, x, y), "x", knots, "p").collect()}
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()))


def test_curve_between_and_beyond_knots(spark):
    knots = table(spark, [0, 1, 1.5, 4], [1, 1, 2, 7]).withColumnRenamed("y", "value")
    at = [(-9.0, 1.0), (0.0, 1.0), (0.3, 1.0), (1.25, 1.5), (2.0, 3.0), (4.0, 7.0), (99.0, 7.0), (None, None)]
    df = spark.createDataFrame([(x, p, "k") for x, p in at] * 2, "x double, want double, value string").repartition(5)
    got = isotonic.read_curve(df, "x", knots, "p")
    assert got.columns == ["x", "want", "value", "p"] and got.count() == 2 * len(at)
    assert got.where(~F.col("p").eqNullSafe(F.col("want"))).isEmpty()
    assert isotonic.read_curve(df, "x", knots.limit(0), "p").where("p is not null").isEmpty()


def test_missing_rows_and_nothing_to_fit(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None)], "x double, y double")
    assert isotonic.isotonic_knots(df, "x", "y").isEmpty()


def test_a_million_rising_points_stay_in_their_slices(spark):
    """Nothing is pooled, so no block leaves its slice and the driver sees one row per slice."""
    points = spark.range(1_000_000).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("s"), F.lit(1.0).alias("w"))
    sent = []
    blocks = isotonic.isotonic_blocks(points)
    sent.append(blocks.groupBy("slice").count().count())
    assert blocks.count() == 1_000_000 and sent[0] >= 2
    assert blocks.where("hi <> lo or s <> 2 * lo").isEmpty()


def test_reading_a_curve_takes_no_frame_that_ends_with_the_slice(spark):
    """Such a frame is summed anew for every row, in quadratic time."""
    knots = spark.createDataFrame([(float(10 * i), float(i * i)) for i in range(40)], "x double, value double")
    rows = spark.range(-50, 500).select(F.col("id").cast("double").alias("v"))
    out = isotonic.read_curve(rows, "v", knots, "c")
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    got = out.orderBy("v").toPandas()
    assert np.allclose(got["c"], np.interp(got["v"], 10.0 * np.arange(40), np.arange(40.0) ** 2))
