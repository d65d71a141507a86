"""Expressions for direction confidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import col, flag, sign_up

# fixed values: inputs of the confidence models
DIRECTION_INPUTS = [
    "p_up_emitted", "abs_mu", "mu_over_mag", "mu_market", "mu_residual",
    "market_residual_agree", "residual_flips_market", "q_iqr80", "q_iqr90",
    "q_skew", "q_median_abs", "q_left_tail", "q_right_tail",
    "mkt_rv", "mkt_ret_disp", "calendar_gap_days", "minute_coverage",
    "history_count", "bench_gap_abs",
]
# fixed values: inputs of the margin model
MARGIN_INPUTS = ["abs_mu", "p_up_emitted", "mu_over_mag", "q_iqr80", "q_skew",
                 "market_residual_agree", "mkt_ret_disp", "calendar_gap_days"]
# fixed values: inputs of the reliability models
MAGNITUDE_INPUTS = [
    "pred_magnitude_pct", "q_iqr80", "q_iqr90", "q_median_abs",
    "mag_mean_20", "mag_std_20", "rv_full_pct", "rv_z_60", "rv_of_rv_20",
    "mkt_rv", "mkt_ret_disp", "calendar_gap_days", "minute_coverage",
    "history_count", "n_missing_features", "bench_gap_abs", "log_dollar_volume",
    "err_hist_mean_20", "err_hist_std_20",
]


def confidence_inputs(df: DataFrame) -> DataFrame:
    """Base direction, aligned probability, margins, agreement flags and the correctness label."""
    base = sign_up("mu_total")
    market, residual, total = (F.signum(c) for c in ("mu_market", "mu_residual", "mu_total"))
    return df.select(
        "*", base.alias("base_direction"),
        F.when(base > 0, F.col("p_up")).otherwise(1.0 - F.col("p_up")).alias("p_up_emitted"),
        F.abs("mu_total").alias("abs_mu"),
        F.when(F.col("pred_magnitude_pct").isNotNull(),
               F.abs("mu_total") / F.greatest("pred_magnitude_pct", F.lit(1e-6))).alias("mu_over_mag"),
        flag(market == residual).alias("market_residual_agree"),
        F.when(market == total, 0.0).otherwise(1.0).alias("residual_flips_market"),
        F.when(base == sign_up("actual_return_pct"), 1.0).otherwise(0.0).alias("correct"),
    )


def flip_rule(base: str | Column, q: str | Column) -> tuple[Column, Column]:
    """Emitted direction and confidence: below one half the direction flips and q becomes 1 - q."""
    base, q = col(base), col(q)
    return F.when(q < 0.5, -base).otherwise(base), F.when(q < 0.5, 1.0 - q).otherwise(q)

