"""Expressions over an array column of conditional quantiles; no UDF is involved."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import col, ratio

# fixed values: quantile levels
LEVELS = [0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95]
CLIP = 1e-6


def crossings(q: str | Column) -> Column:
    """Number of neighbouring quantiles in the wrong order."""
    q = col(q)
    falls = F.zip_with(F.slice(q, 1, F.size(q) - 1), F.slice(q, 2, F.size(q) - 1), lambda a, b: b < a)
    return F.size(F.filter(falls, lambda x: x))


def rearranged(q: str | Column) -> Column:
    return F.array_sort(col(q))


def prob_up(q: str | Column, levels: list[float] = LEVELS) -> Column:
    """P(value > 0): one minus the distribution function at zero, linear between the quantiles."""
    q, n = col(q), len(levels)
    tau = F.array(*[F.lit(float(t)) for t in levels])
    # 1-based index of the last quantile <= 0, kept inside the first n-1 intervals
    j = F.least(F.greatest(F.size(F.filter(q, lambda x: x <= 0)), F.lit(1)), F.lit(n - 1))
    lo, hi = F.element_at(q, j), F.element_at(q, j + 1)
    t_lo, t_hi = F.element_at(tau, j), F.element_at(tau, j + 1)
    inside = t_lo + F.coalesce(ratio(-lo, hi - lo), F.lit(0.0)) * (t_hi - t_lo)
    cdf = F.when(F.element_at(q, 1) > 0, 0.0).when(F.element_at(q, n) <= 0, 1.0).otherwise(inside)
    return F.when(q.isNotNull(), F.least(F.greatest(1.0 - cdf, F.lit(CLIP)), F.lit(1 - CLIP)))


def distribution_features(q: str | Column, levels: list[float] = LEVELS) -> dict[str, Column]:
    """Median, interval widths, skew and tail sizes from the nearest levels."""
    q = col(q)
    at = lambda t: q[min(range(len(levels)), key=lambda i: abs(levels[i] - t))]
    med, lo, hi, lo5, hi5 = at(0.5), at(0.1), at(0.9), at(0.05), at(0.95)
    return {
        "q_median": med, "q_iqr80": hi - lo, "q_iqr90": hi5 - lo5,
        "q_skew": F.when(hi.isNotNull(), (hi + lo - 2 * med) / F.greatest(hi - lo, F.lit(1e-9))),
        "q_left_tail": F.abs(lo5), "q_right_tail": F.abs(hi5), "q_median_abs": F.abs(med),
    }
