"""Ridge against the closed form, and contracts of the Spark ML learners."""
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import glm as glms, learners, linear
from sparkpanel.operators.glm import fit_glm
from sparkpanel.operators.isotonic import fit_isotonic


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 600
    pdf = pd.DataFrame(rng.normal(size=(n, 3)), columns=["a", "b", "c"])
    pdf["b"] = pdf.b * 50 + 1000
    pdf["y"] = np.exp(0.3 * pdf.a) + 0.01 * (pdf.b - 1000) + rng.normal(0, 0.2, n) + 3
    pdf["symbol"] = rng.choice(["A", "B", "C"], n)
    pdf["pred_date"] = [date(2024, 1, 1) + timedelta(days=int(i // 6)) for i in range(n)]
    pdf["id"] = np.arange(n)
    pdf.loc[::17, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).withColumn(
        "empty", F.lit(None).cast("double"))
    return pdf, df


def closed_form(pdf, cols, y, alpha):
    x = pdf[cols].fillna(pdf[cols].median()).fillna(0.0).to_numpy(float)
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / np.where(sd > 0, sd, 1)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(cols)), z.T @ (y - y.mean()))
    return z @ w + y.mean()


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_ridge_equals_closed_form(data, alpha):
    pdf, df = data
    model = linear.fit_ridge(df, ["a", "b", "c", "empty"], F.col("y"), alpha)
    got = df.select("id", model.predict().alias("p")).toPandas().sort_values("id").p
    want = closed_form(pdf.assign(empty=np.nan), ["a", "b", "c", "empty"], pdf.y.to_numpy(), alpha)
    assert np.allclose(got, want)


def test_medians(data):
    pdf, df = data
    got = linear.column_medians(df, ["a", "b", "empty"])
    assert got["a"] == pytest.approx(pdf.a.median()) and got["b"] == pytest.approx(pdf.b.median())
    assert got["empty"] == 0.0


def test_alpha_choice_uses_the_late_rows(data):
    pdf, df = data
    grid = [0.1, 10.0, 1000.0]
    cut = pd.to_datetime(pdf.pred_date).quantile(0.8)
    early, late = pdf[pd.to_datetime(pdf.pred_date) <= cut], pdf[pd.to_datetime(pdf.pred_date) > cut]
    med = early[["a", "b", "c"]].median()
    fill = lambda t: t[["a", "b", "c"]].fillna(med).to_numpy(float)
    x, mean, sd = fill(early), fill(early).mean(0), fill(early).std(0)
    errors = []
    for alpha in grid:
        z = (x - mean) / sd
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (early.y - early.y.mean()))
        errors.append((((fill(late) - mean) / sd @ w + early.y.mean() - late.y) ** 2).mean())
    assert linear.choose_alpha(df, ["a", "b", "c"], F.col("y"), grid) == grid[int(np.argmin(errors))]


def test_isotonic_is_monotone_and_clipped(spark):
    df = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate([1, 3, 2, 4, 4, 6])], "x double, y double")
    fit = fit_isotonic(df, "x", "y")
    grid = spark.createDataFrame([(float(v),) for v in (-5, 0, 0.5, 1.5, 3, 9)], "x double")
    got = [r.p for r in fit(grid, "p").orderBy("x").collect()]
    assert got == pytest.approx([1.0, 1.0, 1.75, 2.5, 4.0, 6.0])


def test_logistic_beats_a_constant_and_stays_inside_zero_one(data):
    _, df = data
    df = df.withColumn("label", (F.col("b") > 1000).cast("double"))
    out = learners.fit_logistic(df, ["b", "a"], "label")(df, "p")
    row = out.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier")).first()
    assert 0 < row.lo and row.hi < 1 and row.brier < 0.2


def test_trees_and_glm_beat_the_mean(data):
    pdf, df = data
    sse = lambda out: out.agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]
    tree = learners.fit_boosted_trees(df, ["a", "b", "c"], F.col("y"), max_iter=5, depth=3)
    glm = fit_glm(df, ["a", "b", "c"], F.col("y"), "tweedie", 1.5)
    for fit in (tree, glm):
        out = fit(df, "p")
        assert out.count() == len(pdf) and sse(out) < pdf.y.var() * 0.8
    unseen = df.limit(3).withColumn("symbol", F.lit("new"))
    assert tree(unseen, "p").where("p is not null").count() == 3


def test_quantile_forest_is_ordered(data):
    pdf, df = data
    forest = learners.fit_quantile_forest(df, ["a", "b", "c"], F.col("y"), [0.1, 0.5, 0.9], ["id"], trees=3, depth=3)
    out = forest(df, "q").toPandas()
    q = np.vstack(out.q)
    assert len(out) == len(pdf) and (np.diff(q, axis=1) >= 0).all()
    inside = ((out.y >= q[:, 0]) & (out.y <= q[:, 2])).mean()
    assert 0.65 < inside < 0.95


@pytest.mark.parametrize("power", [1.0, 1.1, 1.5, 2.0])
def test_glm_is_the_minimum_and_its_deviance_never_rises(data, power):
    pdf, df = data
    rng = np.random.default_rng(7)
    wild = pdf.assign(y=np.where(rng.random(len(pdf)) < 0.1, 0.0 if power < 2 else 1e-4, np.exp(3 * pdf.a.fillna(0) + rng.standard_t(2, len(pdf)))))
    mean = glms.Mean(power, 1e-4 if power == 2 else None, 0.01)
    spark = df.sparkSession
    model = glms.fit_means(spark.createDataFrame(wild[["a", "b", "c", "y"]].astype(object).where(wild[["a", "b", "c", "y"]].notna(), None), "a double, b double, c double, y double"), ["a", "b", "c"], F.col("y"), {"m": mean})["m"]
    fit = model.fit
    assert fit.converged and model.penalty == 0.01 and len(fit.deviances) > 2
    assert all(a >= b for a, b in zip(fit.deviances, fit.deviances[1:]))
    filled = np.column_stack([wild[c].fillna(wild[c].median()) for c in "abc"] + ([wild.a.isna()] if wild.a.isna().any() else []))
    z = np.column_stack([np.ones(len(wild)), (filled - filled.mean(0)) / filled.std(0)]).astype(float)
    y = np.maximum(wild.y.to_numpy(), mean.floor or 0)
    def cost(w):
        return glms.unit_deviance(y, np.exp(z @ w), power).sum() + len(y) * 0.01 * (w[1:] ** 2).sum()
    assert cost(fit.weights) == pytest.approx(fit.deviances[-1], rel=1e-9)
    for k in range(z.shape[1]):
        for step in (1e-3, -1e-3):
            moved = fit.weights.copy()
            moved[k] += step
            assert cost(moved) >= cost(fit.weights) * (1 - 1e-9)


def test_means_of_a_call_share_their_passes(data):
    _, df = data
    means = {"poisson": glms.Mean(1.0), "gamma": glms.Mean(2.0, 1e-4)}
    both = glms.fit_means(df, ["a", "b"], F.col("y"), means)
    for name, mean in means.items():
        alone = glms.fit_means(df, ["a", "b"], F.col("y"), {name: mean})[name]
        assert np.allclose(both[name].fit.weights, alone.fit.weights)


def test_leaf_summaries_keep_their_rank_error(spark):
    rng = np.random.default_rng(4)
    leaf, y = rng.integers(0, 4, (3000, 2)), rng.normal(size=3000)
    levels, accuracy = [0.05, 0.5, 0.95], 100
    rows = spark.createDataFrame([([float(a), float(b)], float(v)) for (a, b), v in zip(leaf, y)], "_leaf array<double>, _y double")
    table = learners.leaf_table(rows.repartition(5), levels, accuracy).first()._table
    assert len(table) == 2
    for tree, at in table.items():
        assert set(at) == {0, 1, 2, 3}
        for k, got in at.items():
            here = np.sort(y[leaf[:, tree] == k])
            for p, q in zip(levels, got):
                assert q in here and abs(np.searchsorted(here, q) + 1 - p * len(here)) <= len(here) / accuracy + 1


def test_ridge_of_all_folds_in_one_pass(data):
    pdf, df = data
    alphas, features = [0.1, 10.0, 1000.0], ["a", "b", "c", "empty"]
    ends = [date(2024, 1, 1) + timedelta(days=d) for d in (40, 60, 99)]
    for end, model in zip(ends, linear.fit_ridge_folds(df, ends, features, F.col("y"), alphas)):
        past = df.where(F.col("pred_date") <= F.lit(end))
        alone = linear.fit_ridge_grid(past, features, F.col("y"), alphas)
        assert model.alpha == alone.alpha and model.imputer.fill == pytest.approx(alone.imputer.fill)
        assert np.allclose(model.weights, alone.weights) and model.intercept == pytest.approx(alone.intercept)


def test_non_negative_weights_of_many_forecasts():
    from itertools import combinations

    from sparkpanel.operators.calibration import nonnegative_weights

    rng = np.random.default_rng(3)

    def exhaustive(gram, target):
        best, low = np.zeros(len(target)), 0.0
        for size in range(1, len(target) + 1):
            for s in map(list, combinations(range(len(target)), size)):
                w = np.linalg.lstsq(gram[np.ix_(s, s)], target[s], rcond=None)[0]
                cost = w @ gram[np.ix_(s, s)] @ w - 2 * w @ target[s]
                if (w >= 0).all() and cost < low:
                    low, best = cost, np.zeros(len(target))
                    best[s] = w
        return best

    for trial in range(60):
        k = int(rng.integers(1, 7))
        x, y = rng.normal(size=(50, k)) + rng.normal(), rng.normal(size=50)
        assert np.allclose(nonnegative_weights(x.T @ x, x.T @ y), exhaustive(x.T @ x, x.T @ y), atol=1e-8)
    x = np.abs(rng.normal(size=(500, 40)))
    y = x @ np.r_[np.ones(10), np.zeros(30)] + rng.normal(size=500)
    w = nonnegative_weights(x.T @ x, x.T @ y)
    slope = x.T @ y - x.T @ x @ w
    assert (w >= 0).all() and np.abs(slope[w > 0]).max() < 1e-6 and slope[w == 0].max() < 1e-6
    twin = np.column_stack([x[:, 0], x[:, 0]])
    assert nonnegative_weights(twin.T @ twin, twin.T @ y).sum() > 0 and (nonnegative_weights(np.eye(2), -np.ones(2)) == 0).all()
