"""Ranks, positions, quantiles and ECDFs must equal pandas, however many slices there are."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import calibration as calib, metrics as met, ranking


@pytest.fixture
def sliced(spark):
    """Sets how many slices range partitioning makes, without merging small ones."""
    names = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": None}
    before = {k: spark.conf.get(k) for k in names}

    def of(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 400
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "id": np.arange(n),
        "x": np.where(rng.random(n) < 0.35, 1.0, rng.integers(0, 20, n).astype(float)), "y": rng.normal(size=n)})
    pdf.loc[rng.choice(n, 25, replace=False), "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df


@pytest.mark.parametrize("slices", [1, 7])
def test_average_ranks(frame, sliced, slices):
    pdf, df = frame
    sliced(slices)
    out = ranking.average_ranks(df, ["g"], ["x", "y"], ["id"], count_prefix="n_").toPandas().sort_values("id")
    assert len(out) == len(pdf)
    for c in ("x", "y"):
        want = pdf.groupby("g")[c].rank()
        assert np.allclose(out[f"rank_{c}"].to_numpy(float), want.to_numpy(), equal_nan=True)
        assert (out[f"n_{c}"].to_numpy() == pdf.groupby("g")[c].transform("count").to_numpy()).all()


@pytest.mark.parametrize("slices", [1, 7])
def test_positions_are_dense_and_ordered(frame, sliced, slices):
    pdf, df = frame
    sliced(slices)
    out = ranking.positions(df, ["g"], ["y", "id"], ["id"]).toPandas().sort_values("id")
    want = pdf.sort_values(["g", "y", "id"]).groupby("g").cumcount().sort_index()
    assert (out["position"].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("slices", [1, 7])
def test_quantiles(frame, sliced, slices):
    pdf, df = frame
    sliced(slices)
    out = ranking.quantiles(df, ["g"], "x", [0.0, 0.3, 0.5, 0.95, 1.0]).toPandas()
    for r in out.itertuples():
        assert r.quantile == pytest.approx(pdf[pdf.g == r.g].x.quantile(r.prob))
    assert len(out) == 15
    whole = ranking.quantiles(df, [], "y", [0.5]).first()["quantile"]
    assert whole == pytest.approx(pdf.y.median())


def test_ranks_do_not_depend_on_partitioning(frame):
    _, df = frame
    run = lambda d: {(r.id, r.rank_x) for r in ranking.average_ranks(d, ["g"], ["x"], ["id"]).collect()}
    assert run(df.repartition(1)) == run(df.repartition(16))


@pytest.mark.parametrize("slices", [1, 3])
def test_ecdf_confidence(spark, sliced, slices):
    sliced(slices)
    train = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 2)], "risk double")
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate((-1, 1, 2, 2.5, 5, 4))], "id int, risk double")
    out = calib.ecdf_confidence(rows, train, "risk", ["id"]).orderBy("id").collect()
    sorted_train = np.sort([1, 2, 3, 4, 2])
    want = [1 - np.searchsorted(sorted_train, v, side="left") / 5 for v in (-1, 1, 2, 2.5, 5, 4)]
    assert [r.confidence for r in out] == pytest.approx(want)


def test_risk_map_is_monotone_and_bounded(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "risk double")
    rows = spark.createDataFrame([(0, -1.0), (1, 1.0), (2, 2.5), (3, 5.0)], "id int, risk double")
    got = [r.confidence for r in calib.ecdf_confidence(rows, train, "risk", ["id"]).orderBy("id").collect()]
    assert got == sorted(got, reverse=True) and min(got) >= 0 and max(got) <= 1


def test_decile_rule(spark):
    for n in (10, 11, 25, 100, 103):
        df = spark.range(n).select("id", F.col("id").cast("double").alias("v"))
        out = met.with_decile(df, [], "v", ["id"], "d").toPandas().sort_values("id")
        r = np.arange(n)
        want = np.maximum(-(-r * 10 // (n - 1)), 1) - 1
        assert (out.d.to_numpy() == want).all()


def test_spearman_matches_pandas(frame):
    pdf, df = frame
    got = {r.g: r.spearman for r in met.spearman(df, ["g"], "x", "y", ["id"]).collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert got[g] == pytest.approx(part.x.rank().corr(part.y.rank()))
