"""Confidence of the direction and of the magnitude forecast."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.confidence import (
    DIRECTION_INPUTS, MAGNITUDE_INPUTS, MARGIN_INPUTS, confidence_inputs, flip_rule,
)
from ..operators import calibration as calib, cross_section as cs, learners, linear, metrics as met, rolling
from ..operators.isotonic import fit_isotonic
from ..operators.quality import require_finite
from ..operators.selection import select_direction_confidence, select_magnitude_confidence
from ..sources.staging import stage
from .magnitude import _union

KEYS = ["pred_date", "symbol"]
CLIP = 1e-6
PANEL_INPUTS = ["mkt_rv", "mkt_ret_disp", "calendar_gap_days", "minute_coverage", "history_count", "bench_gap_abs"]


def _clipped(predict: learners.Predictor) -> learners.Predictor:
    def run(df: DataFrame, out: str) -> DataFrame:
        return predict(df, out).withColumn(out, F.least(F.greatest(out, F.lit(CLIP)), F.lit(1 - CLIP)))
    return run


def _constant(train: DataFrame) -> learners.Predictor:
    rate = float(train.agg(F.avg("correct")).first()[0])
    return lambda df, out: df.withColumn(out, F.lit(rate))


# name -> fit(train) -> predictor of P(base direction is right)
DIRECTION_CANDIDATES: dict[str, Callable[[DataFrame], learners.Predictor]] = {
    "C0_constant": _constant,
    "C1_raw_quantile_prob": lambda t: _clipped(lambda df, out: df.withColumn(out, F.col("p_up_emitted"))),
    "C2_platt": lambda t: learners.fit_logistic(t, ["p_up_emitted"], "correct", 1.0),
    "C3_isotonic": lambda t: _clipped(fit_isotonic(t, "p_up_emitted", "correct")),
    "C4_logistic_meta": lambda t: learners.fit_logistic(t, DIRECTION_INPUTS, "correct", 0.1),
    "C5_isotonic_margin": lambda t: _clipped(fit_isotonic(t, "abs_mu", "correct")),
    "C6_logistic_margin_prob": lambda t: learners.fit_logistic(t, MARGIN_INPUTS, "correct", 1.0),
}


def direction_inputs(store: DataFrame, panel: DataFrame, magnitude: DataFrame) -> DataFrame:
    """Direction store with its magnitude forecast and the panel columns the candidates read."""
    extra = panel.select(*KEYS, *PANEL_INPUTS)
    return confidence_inputs(store.join(magnitude.select(*KEYS, "pred_magnitude_pct"), KEYS, "left").join(
        extra, KEYS, "left"))


def direction_candidates(train: DataFrame, valid: DataFrame,
                         names: list[str] | None = None) -> tuple[DataFrame, dict[str, learners.Predictor]]:
    """Candidate table on validation and the fitted predictors."""
    train = train.where("p_up_emitted is not null and mu_total is not null")
    fitted = {n: DIRECTION_CANDIDATES[n](train) for n in names or list(DIRECTION_CANDIDATES)}
    rows = _union([
        f(valid, "q").select(F.lit(n).alias("model"), "base_direction", "actual_return_pct", "q")
        for n, f in fitted.items()])
    return calib.direction_candidate_table(stage(rows, "direction-candidates"), ["model"]), fitted


# ---- magnitude reliability ----------------------------------------------------------
def fit_two_stage(train: DataFrame, use_tree: bool = False, seed: int = 42,
                  features: list[str] | None = None, **tree) -> learners.Predictor:
    """Predicted absolute error: isotonic in the forecast, plus a model of what that leaves."""
    features = features or MAGNITUDE_INPUTS
    scale = fit_isotonic(train, "pred_magnitude_pct", "oof_abs_error")
    rest = stage(scale(train, "_scale").withColumn("_rest", F.col("oof_abs_error") - F.col("_scale")), "two-stage")
    if use_tree:
        tree = {"max_iter": 100, "depth": 3, "step": 0.05, "min_leaf": 500, **tree}
        second = learners.fit_boosted_trees(rest, features, F.col("_rest"), by_symbol=False, seed=seed, **tree)
    else:
        model = linear.fit_ridge(rest, features, F.col("_rest"), 100.0, indicators=True)
        second = lambda df, out: df.withColumn(out, model.predict())

    def predict(df: DataFrame, out: str) -> DataFrame:
        return second(scale(df, "_scale"), "_rest").withColumn(out, F.col("_scale") + F.col("_rest")).drop("_scale", "_rest")
    return predict


def error_rows(store: DataFrame, panel: DataFrame, magnitude: DataFrame) -> DataFrame:
    """Forecast errors with the reliability inputs (without the error history)."""
    rows = store.join(magnitude.select(*KEYS, "pred_magnitude_pct"), KEYS, "left").withColumn(
        "oof_abs_error", F.abs(F.col("pred_magnitude_pct") - F.col("actual_magnitude_pct")))
    extra = [c for c in MAGNITUDE_INPUTS if c in panel.columns and c not in rows.columns]
    return rows.join(panel.select(*KEYS, *extra), KEYS, "left")


def reliability_training(store: DataFrame, panel: DataFrame, magnitude: DataFrame) -> DataFrame:
    return rolling.error_history(error_rows(store, panel, magnitude).where("oof_abs_error is not null"))


def magnitude_confidences(train: DataFrame, rows: DataFrame, seed: int = 42,
                          names: list[str] | None = None, **tree) -> DataFrame:
    """Long (model, row, confidence, scored) for every candidate; rows need the error history attached.

    ``scored`` is what the report ranks: the confidence, but for D0 the negative forecast itself, whose ties stay ties.
    """
    names = names or ["D0_neg_magnitude", "D1_scale_only", "D2_two_stage_ridge", "D3_two_stage_tree"]
    parts = []
    for name in names:
        if name == "D0_neg_magnitude":
            scored = calib.inverse_rank_confidence(rows, "pred_magnitude_pct", KEYS)
        else:
            fit = fit_isotonic(train, "pred_magnitude_pct", "oof_abs_error") if name == "D1_scale_only" \
                else fit_two_stage(train, name.endswith("tree"), seed, **tree)
            scored = calib.ecdf_confidence(fit(rows, "_risk"), fit(train, "_risk"), "_risk", KEYS)
        judged = -F.col("pred_magnitude_pct") if name == "D0_neg_magnitude" else F.col("confidence")
        parts.append(scored.select(F.lit(name).alias("model"), *KEYS, "pred_magnitude_pct", "oof_abs_error",
                                   "confidence", judged.alias("scored")))
    return _union(parts)


def magnitude_candidates(confidences: DataFrame) -> DataFrame:
    return met.reliability_report(
        confidences, ["model"], "scored", "oof_abs_error", "pred_magnitude_pct", ["model", *KEYS])


@dataclass(frozen=True)
class Confidence:
    direction_table: DataFrame
    magnitude_table: DataFrame
    direction_choice: str
    magnitude_choice: str
    predictions: DataFrame


def research(oof: DataFrame, valid: DataFrame, panel: DataFrame, oof_magnitude: DataFrame,
             valid_magnitude: DataFrame, seed: int = 42, **tree) -> Confidence:
    """Fit both confidence branches out of fold, choose on validation, assemble its predictions."""
    train_c = stage(direction_inputs(oof, panel, oof_magnitude), "confidence-train")
    valid_c = stage(direction_inputs(valid, panel, valid_magnitude), "confidence-valid")
    table_c, fitted = direction_candidates(train_c, valid_c)
    table_c = stage(table_c, "direction-confidence")
    pick_c = select_direction_confidence(table_c).first()["model"]

    train_d = stage(reliability_training(oof, panel, oof_magnitude), "reliability-train")
    rows_d = stage(calib.attach_error_history(error_rows(valid, panel, valid_magnitude), train_d), "reliability-valid")
    conf_d = stage(magnitude_confidences(train_d, rows_d, seed, **tree), "magnitude-confidences")
    table_d = stage(magnitude_candidates(conf_d), "magnitude-confidence")
    pick_d = select_magnitude_confidence(table_d).first()["model"]

    d, conf = flip_rule("base_direction", "q")
    chosen = conf_d.where(F.col("model") == pick_d).select(*KEYS, F.col("confidence").alias("conf_magnitude"))
    rows = fitted[pick_c](valid_c, "q").join(chosen, KEYS).select(
        *KEYS, "pred_magnitude_pct", d.cast("int").alias("pred_direction"), conf.alias("conf_direction"),
        "conf_magnitude", "actual_return_pct", "actual_magnitude_pct", F.lit("valid").alias("split"))
    rows = stage(cs.session_mean(stage(rows, "assembled"), "actual_return_pct", "universe_mean_pct"), "predictions")
    require_finite(rows, [c for c, t in rows.dtypes if t in ("double", "int")], "validation predictions")
    return Confidence(table_c, table_d, pick_c, pick_d, rows)
