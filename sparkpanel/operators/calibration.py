"""Calibration, rank-based confidences, error-history lookup and the forecast blend."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, named
from ..sources.staging import stage
from .ranking import join_by_value, positions, running_weight

HISTORY_COLUMNS = ["err_hist_mean_20", "err_hist_std_20"]


def smearing_factor(y: str | Column, pred: str | Column) -> Column:
    """Mean of exp(residual) on the log scale (aggregate)."""
    return F.avg(F.exp(col(y) - col(pred)))


def from_log1p(z: str | Column, smear: float | Column) -> Column:
    """Back to the original scale, never below zero."""
    raw = F.exp(col(z)) * smear - 1.0
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))


def affine_calibration(df: DataFrame, groups: list[str], pred: str, actual: str) -> DataFrame:
    """Least-squares line of the outcome on the forecast with a slope of at least zero."""
    return df.groupBy(*groups).agg(
        F.regr_intercept(actual, pred).alias("calib_a0"),
        F.greatest(F.regr_slope(actual, pred), F.lit(0.0)).alias("calib_b"))


def apply_affine(pred: str | Column, a0: float | Column, b: float | Column) -> Column:
    value = a0 + b * col(pred)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def ecdf_confidence(df: DataFrame, train: DataFrame, risk: str, row_keys: list[str], out: str = "confidence") -> DataFrame:
    """One minus the share of training risks strictly below the row's risk."""
    mark = lambda t, in_train: t.select(F.col(risk).cast("double").alias("_v"), F.lit(in_train).alias("_t")).where(
        "_v is not null")
    hist = mark(train, 1).unionAll(mark(df, 0)).groupBy("_v").agg(
        F.sum("_t").alias("_train"), F.sum(1 - F.col("_t")).alias("n"))
    below = running_weight(hist, [], "_v", "_train", total="_total")
    share = F.least(F.greatest(1.0 - F.col("below") / F.col("_total"), F.lit(0.0)), F.lit(1.0))
    table = below.where("n > 0").select("_v", "n", share.alias(out))
    rows = df.withColumn("_v", F.col(risk).cast("double"))
    return join_by_value(rows, table, ["_v"]).drop("_v")


def inverse_rank_confidence(df: DataFrame, value: str, row_keys: list[str], groups: list[str] | None = None,
                            out: str = "confidence") -> DataFrame:
    """Position in descending order of ``value`` divided by the number of rows."""
    groups = groups or []
    placed = positions(df, groups, [-F.col(value), *row_keys], row_keys, "_pos", "_size")
    return placed.withColumn(out, F.col("_pos") / F.col("_size")).drop("_pos", "_size")


def attach_error_history(df: DataFrame, history: DataFrame) -> DataFrame:
    """Error history of the exact date for training rows, the last known one for later rows.

    Each column keeps its own last non-missing value.  Key copies in ``history`` are
    reduced by aggregation before the join.
    """
    keys = ["pred_date", "symbol"]
    missing = [c for c in [*keys, *HISTORY_COLUMNS] if c not in history.columns]
    if missing:
        raise KeyError(f"no {', '.join(missing)} in the error history")
    exact = history.groupBy(*keys).agg(*[F.max(c).alias(f"_at_{c}") for c in HISTORY_COLUMNS])
    last = exact.groupBy("symbol").agg(*[
        F.max_by(f"_at_{c}", F.when(F.col(f"_at_{c}").isNotNull(), F.col("pred_date"))).alias(f"_last_{c}")
        for c in HISTORY_COLUMNS])
    joined = df.drop(*HISTORY_COLUMNS).join(exact, keys, "left").join(last, "symbol", "left")
    return joined.select(
        *[c for c in df.columns if c not in HISTORY_COLUMNS],
        *[F.when(F.col("split") == "train", F.col(f"_at_{c}")).otherwise(F.col(f"_last_{c}")).alias(c)
          for c in HISTORY_COLUMNS])


def gram_table(df: DataFrame, preds: list[str], actual: str) -> DataFrame:
    """Long (left, right, value) cross products of the forecasts and with the outcome, one aggregation."""
    pairs = [(a, b) for i, a in enumerate(preds) for b in [*preds[i:], actual]]
    entries = F.explode(F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("value"))
        for i, (a, b) in enumerate(pairs)]))
    complete = df.dropna(subset=[f"`{c}`" for c in [*preds, actual]])
    sums = complete.agg(*[F.sum(named(a) * named(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return sums.select(entries.alias("e")).select("e.*")


def nonnegative_weights(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative least squares from the normal equations, by an active set.

    The forecast whose weight would lower the error fastest joins the set; where the set's own solution is not positive, the weights
    move towards it until the first reaches zero and leaves.  Each set is met once, as the error falls.
    """
    k = len(target)
    weights, inside = np.zeros(k), np.zeros(k, bool)
    least = 1e-12 * max(float(np.abs(target).max(initial=0)), 1e-300)
    while True:
        slope = np.where(inside, -np.inf, target - gram @ weights)
        if not k or inside.all() or slope.max() <= least:
            return weights
        joining = int(slope.argmax())
        inside[joining] = True
        while True:
            s = np.flatnonzero(inside)
            free = np.zeros(k)
            free[s] = np.linalg.lstsq(gram[np.ix_(s, s)], target[s], rcond=None)[0]
            below = s[free[s] <= 0]
            if not len(below):
                break
            step = np.min(weights[below] / np.maximum(weights[below] - free[below], 1e-300))
            weights = weights + step * (free - weights)
            gone = inside & ((weights <= 1e-15 * max(weights.max(), 1e-300)) & (free <= 0))
            weights[gone], inside[gone] = 0.0, False
        if not inside[joining]:
            # a copy of what is inside: it can lower nothing
            return weights
        weights = free


def blend_weights(df: DataFrame, preds: list[str], actual: str) -> dict[str, float]:
    """Non-negative blend weights that sum to one, rounded to four digits; equal if all are zero."""
    cells = {(r.left, r.right): r.value for r in gram_table(df, preds, actual).collect()}
    at = lambda a, b: cells[(a, b)] if (a, b) in cells else cells[(b, a)]
    gram = np.array([[at(a, b) for b in preds] for a in preds], dtype=float)
    w = nonnegative_weights(gram, np.array([at(a, actual) for a in preds], dtype=float))
    w = w / w.sum() if w.sum() > 0 else np.full(len(preds), 1 / len(preds))
    return {p: float(x) for p, x in zip(preds, np.round(w, 4))}


def blended(weights: dict[str, float]) -> Column:
    """Weighted sum of forecast columns."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(float(w)) * named(name)
    return total


def candidate_table(df: DataFrame, groups: list[str], pred: str, actual: str, baseline: str,
                    row_keys: list[str], **gate) -> DataFrame:
    """Magnitude candidates side by side: scores, daily rank correlation, skill over the baseline, gates.

    Days need more than five rows and a forecast that varies to count in the rank correlation.
    """
    from . import metrics as met

    sq = lambda x: x * x
    p, a, v = F.col(pred), F.col(actual), F.col(baseline)
    base = df.groupBy(*groups).agg(
        met.magnitude_score(pred, actual).alias("magnitude_score"), F.avg(F.abs(p - a)).alias("mae"),
        F.sqrt(F.avg(sq(p - a))).alias("rmse"),
        (1 - F.try_divide(F.sum(F.when(v.isNotNull(), sq(p - a))), F.sum(sq(v - a)))).alias("r2_vs_vol"))
    ic = met.daily_rank_ic(df, groups, pred, actual, row_keys, least=6).select(*groups, "rank_ic")
    return base.join(ic, groups, "left").join(met.semantic_gate(df, groups, pred, actual, **gate), groups)


def direction_candidate_table(df: DataFrame, groups: list[str], q: str = "q") -> DataFrame:
    """Direction-confidence candidates after the flip rule: calibration, lift, flips, pooled score."""
    from ..functions.confidence import flip_rule
    from . import metrics as met

    d, conf = flip_rule("base_direction", q)
    rows = df.select(*groups, "actual_return_pct", F.col(q).alias("_q"), d.alias("d"), conf.alias("conf"))
    rows = rows.withColumn("correct_final", met.hit("d", "actual_return_pct"))
    a, w = F.col("actual_return_pct"), 2 * F.col("conf") - 1
    weighted = F.try_divide(F.sum(w * F.col("d") * a), F.sum(w * F.abs(a)))
    pooled = met.direction_score("d", "actual_return_pct")
    scores = rows.groupBy(*groups).agg(
        (weighted - pooled).alias("lift"), F.count_if(F.col("_q") < 0.5).alias("flips"), pooled.alias("pooled_ds"))
    return met.calibration_report(rows, groups, "conf", "correct_final").join(scores, groups)
