"""The registered model queries hand the whole job on: all folds, candidates, inputs and rounds."""
from datetime import date, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpanel.catalog import models
from sparkpanel.functions.confidence import MAGNITUDE_INPUTS
from sparkpanel.operators import calibration as calib, cross_section as cs, glm, learners
from sparkpanel.plans import confidence as conf, direction as dirn, final, magnitude as mag

TRAIN, VALID = 700, 40


class Stop(Exception):
    pass


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    days, symbols = np.arange(TRAIN + VALID), ["A", "B", "C"]
    pdf = pd.DataFrame([(date(2020, 1, 1) + timedelta(days=int(d)), s, "train" if d < TRAIN else "valid") for d in days for s in symbols],
                       columns=["pred_date", "symbol", "split"])
    own = [c for c in MAGNITUDE_INPUTS if not c.startswith(("q_", "err_hist", "pred_"))]
    for c in own:
        pdf[c] = rng.gamma(2.0, 1.0, len(pdf))
    pdf["actual_return_pct"] = rng.normal(0, 1, len(pdf)) * pdf.mag_mean_20
    pdf["actual_magnitude_pct"] = pdf.actual_return_pct.abs()
    return spark.createDataFrame(pdf).localCheckpoint()


def test_final_scoring_hands_on_the_whole_job(spark, panel, monkeypatch):
    seen = {}
    table = spark.createDataFrame([("M7_poisson", "raw", 0.3, 1.0, 2.0, True, True)],
                                  "model string, variant string, magnitude_score double, rmse double, mean_gap_pct double, "
                                  "passes_mean_gate boolean, passes_slope_gate boolean")
    forecasts = panel.select(F.lit("M7_poisson").alias("model"), *mag.KEYS, F.lit(1.0).alias("pred"))

    def tournament(rows, folds, registry, inputs, cfg):
        seen.update(folds=folds, registry=registry, inputs=inputs, mcfg=cfg)
        return SimpleNamespace(oof=forecasts, valid=forecasts, weights={}, table=table)

    def direction(rows, folds, inputs, cfg):
        seen.update(direction_folds=folds, direction_inputs=inputs, dcfg=cfg)
        return SimpleNamespace(oof=None, valid=None, shrinkage=1.0)

    def research(*args, **tree):
        seen.update(research_tree=tree)
        return SimpleNamespace(direction_choice="C2_platt", magnitude_choice="D1_scale_only")

    def score_all(rows, contest, direction, choice, inputs, registry, mcfg, dcfg, **tree):
        seen.update(last=(inputs, registry, mcfg, dcfg, tree))
        raise Stop

    monkeypatch.setattr(models, "model_panel", lambda spark, sf: panel)
    monkeypatch.setattr(mag, "tournament", tournament)
    monkeypatch.setattr(dirn, "research", direction)
    monkeypatch.setattr(conf, "research", research)
    monkeypatch.setattr(final, "score_all", score_all)
    with pytest.raises(Stop):
        models.final_scoring(spark, "unused")
    assert seen["folds"].count() == seen["direction_folds"].count() == 5
    assert set(seen["registry"]) == set(mag.candidates(mag.MagnitudeConfig())) and len(seen["registry"]) == 11
    assert seen["inputs"] == seen["direction_inputs"] == cs.feature_columns(panel)
    whole, legs = mag.MagnitudeConfig(), dirn.DirectionConfig()
    assert (seen["mcfg"].tree, seen["mcfg"].forest) == (whole.tree, whole.forest)
    assert (seen["dcfg"].tree, seen["dcfg"].forest) == (legs.tree, legs.forest)
    assert seen["research_tree"] == {} and seen["last"] == (seen["inputs"], seen["registry"], seen["mcfg"], seen["dcfg"], {})


def test_blend_of_models_with_a_dot_in_their_name(spark):
    rng = np.random.default_rng(6)
    y = rng.gamma(2.0, 1.0, 200)
    rows = [(m, date(2024, 1, 1) + timedelta(days=i), "A", float(p), float(v), 1.0)
            for m, k in (("M3_tweedie_1.1", 1.0), ("M3_tweedie_1.3", 3.0)) for i, (v, p) in enumerate(zip(y, k * y))]
    long = spark.createDataFrame(rows, f"model string, pred_date date, symbol string, pred double, {mag.TARGET} double, mag_mean_20 double")
    members = mag.mean_models(["M3_tweedie_1.1", "M3_tweedie_1.3"])
    assert sum(calib.blend_weights(mag.wide_forecasts(long, members), members, mag.TARGET).values()) == pytest.approx(1.0)
    weights = {"M3_tweedie_1.1": 0.25, "M3_tweedie_1.3": 0.75}
    got = mag.with_blend(long, weights).where(F.col("model") == mag.BLEND).select(mag.TARGET, "pred").toPandas()
    assert len(got) == 200 and np.allclose(got.pred, 2.5 * got[mag.TARGET])
    # the refit of the blend for the final scoring
    registry = {"M3_tweedie_1.1": lambda train, features, cfg: lambda df, out: df.withColumn(out, F.lit(2.0)),
                "M3_tweedie_1.3": lambda train, features, cfg: lambda df, out: df.withColumn(out, F.lit(4.0))}
    choice = final.Selection(mag.BLEND, "raw", weights, 1.0, "", "")
    few = long.limit(3)
    out = final._forecast(few, few, choice, registry, [], mag.MagnitudeConfig())
    assert [r.raw_magnitude for r in out.collect()] == [3.5] * 3 and out.columns == [*few.columns, "raw_magnitude"]


def test_inputs_without_spread_leave_a_mean_as_it_is(panel):
    wide = panel.withColumns({"none": F.lit(None).cast("double"), "flat": F.lit(7.0)})
    means = {"poisson": glm.Mean(1.0)}
    few, more = (glm.fit_means(wide, names, F.col(mag.TARGET), means)["poisson"].fit
                 for names in (["mag_mean_20"], ["mag_mean_20", "none", "flat"]))
    assert few.converged and more.weights[:2] == pytest.approx(few.weights) and more.weights[2:] == pytest.approx(0.0)


def test_tree_learners_have_as_many_tasks_as_their_cells_ask_for(panel, monkeypatch):
    data = panel.repartition(6)
    assert learners._in_whole_tasks(data, 10).rdd.getNumPartitions() == 1
    monkeypatch.setattr(learners, "TASK_CELLS", 3 * (TRAIN + VALID) * 10 // 4)
    assert learners._in_whole_tasks(data, 10).rdd.getNumPartitions() == 4
    monkeypatch.setattr(learners, "TASK_CELLS", 1)
    assert learners._in_whole_tasks(data, 10).rdd.getNumPartitions() == 6


def test_two_stage_reliability_has_all_inputs_rows_and_rounds(spark, panel, monkeypatch):
    seen, rounds = {}, []
    widths = panel.where("pred_date >= '2020-03-01'").select(
        *mag.KEYS, F.lit(1.0).alias("q_iqr80"), F.lit(2.0).alias("q_iqr90"), F.lit(3.0).alias("q_median_abs"))

    def quantile_features(rows, folds, features, cfg):
        seen.update(folds=folds, features=features, cfg=cfg)
        return widths

    def confidences(train, rows, *args, **settings):
        seen.update(train=train, valid=rows, args=args, settings=settings)
        raise Stop

    def boosted(train, features, *args, max_iter, **settings):
        rounds.append((features, max_iter))
        return lambda df, out: df.withColumn(out, F.lit(0.0))

    monkeypatch.setattr(models, "model_panel", lambda spark, sf: panel)
    monkeypatch.setattr(dirn, "quantile_features", quantile_features)
    monkeypatch.setattr(conf, "magnitude_confidences", confidences)
    with pytest.raises(Stop):
        models.two_stage_reliability(spark, "unused")
    assert seen["folds"].count() == 5 and seen["features"] == cs.feature_columns(panel) and seen["cfg"].forest == dirn.DirectionConfig().forest
    assert set(MAGNITUDE_INPUTS) <= set(seen["train"].columns) and set(MAGNITUDE_INPUTS) <= set(seen["valid"].columns)
    assert seen["train"].count() == 3 * TRAIN and seen["valid"].count() == 3 * VALID
    monkeypatch.setattr(learners, "fit_boosted_trees", boosted)
    conf.fit_two_stage(seen["train"], True, *seen["args"], **seen["settings"])
    assert rounds == [(MAGNITUDE_INPUTS, 100)]


def test_quantile_features_come_from_forests_that_did_not_see_the_row(spark, panel):
    cfg = dirn.DirectionConfig(forest=dict(trees=2, depth=2, min_leaf=20))
    folds = models.model_folds(panel, 2, 400)
    out = dirn.quantile_features(panel, folds, ["mag_mean_20", "mag_std_20"], cfg).toPandas()
    first = min(r.predict_start for r in folds.collect())
    want = panel.where(F.col("pred_date") >= F.lit(first)).count()
    assert len(out) == want == 3 * (400 + VALID) and not out.duplicated(mag.KEYS).any()
    assert np.isfinite(out.q_iqr80).all() and (out.q_iqr90 >= out.q_iqr80).all()
