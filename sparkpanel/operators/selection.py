"""Selection rules over small candidate tables: filter, order, first row, with fallbacks."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

TIE_BAND = 0.01


def select_magnitude(table: DataFrame, shadow_prefix: str = "S_", baseline: str = "M0_trailing20") -> DataFrame:
    """Gate survivors by score, then RMSE; without any, the smallest absolute mean gap.

    Shadow models never win; the baseline wins only in the fallback.
    """
    real = table.where(~F.col("model").startswith(shadow_prefix))
    passed = F.col("passes_mean_gate") & F.col("passes_slope_gate") & (F.col("model") != baseline)
    return (
        real.withColumn("_pass", passed)
        .orderBy(F.desc("_pass"),
                 F.when(F.col("_pass"), -F.col("magnitude_score")).otherwise(F.abs("mean_gap_pct")),
                 "rmse", "model", "variant")
        .limit(1).drop("_pass"))


def select_shrinkage(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("pooled_ds"), F.desc("residual_ds"), "lambda").limit(1)


def select_direction_confidence(table: DataFrame, constant: str = "C0_constant") -> DataFrame:
    """Lowest Brier among candidates that lift and have skill; among all if there are none."""
    good = (F.col("brier_skill") >= 0) & (F.col("lift") > 0) & (F.col("model") != constant)
    return (
        table.withColumn("_good", F.coalesce(good, F.lit(False)))
        .orderBy(F.desc("_good"), "brier", "log_loss", "ece_10", "model").limit(1).drop("_good"))


def select_magnitude_confidence(table: DataFrame, excluded: tuple[str, ...] = ("D1_scale_only",)) -> DataFrame:
    """Best within-decile score among candidates within the tie band of the best overall score."""
    w = Window.partitionBy()
    cand = table.where(~F.col("model").isin(*excluded)).withColumn("_top", F.max("conf_magnitude_score").over(w))
    return (
        cand.where(F.col("conf_magnitude_score") >= F.col("_top") - TIE_BAND)
        .orderBy(F.desc("within_magnitude_decile"), "model").limit(1).drop("_top"))
