"""Same-session features: ranges, market aggregates, cross-sectional ranks and z-scores.

A session may hold any number of rows, so nothing here opens a window over a session.
Session aggregates are combined map-side, staged (one row per session) and joined back;
ranks go through ``operators.ranking``.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import flag, pct_change, ratio
from ..sources.staging import stage
from .ranking import average_ranks

# fixed values: columns with a cross-sectional rank and z-score
RELATIVE_COLUMNS = [
    "ret_oc_pct", "rv_full_pct", "return_final_60_pct", "return_final_30_pct",
    "bench_gap_pct", "volume_ratio_20", "close_location", "range_pct",
    "semivariance_imbalance", "mag_mean_20", "close_vs_vwap_pct", "amihud_20",
]

# fixed values: columns that are never model inputs
NON_FEATURES = {
    "symbol", "pred_date", "target_date", "split",
    "open", "high", "low", "close", "volume", "prev_close", "target_open", "target_close",
    "actual_return_pct", "actual_magnitude_pct", "actual_direction",
    "session_open", "session_high", "session_low", "session_close", "vwap",
    "dollar_volume", "total_volume",
}

# fixed values: features that depend on the official-close basis
BENCHMARK_FEATURES = [
    "bench_gap_pct", "bench_gap_abs", "cs_rank_bench_gap_pct", "cs_z_bench_gap_pct", "mkt_bench_gap",
]


def range_volatility(df: DataFrame) -> DataFrame:
    """Daily returns, range, close location, Parkinson and Garman-Klass; needs prev_close."""
    log_range = F.when((F.col("high") > 0) & (F.col("low") > 0), F.ln(ratio("high", "low")))
    log_body = F.when((F.col("close") > 0) & (F.col("open") > 0), F.ln(ratio("close", "open")))
    gk = 0.5 * log_range * log_range - (2 * math.log(2) - 1) * log_body * log_body
    spread = F.col("high") - F.col("low")
    return df.select(
        "*",
        pct_change("close", "prev_close").alias("ret_cc_pct"),
        pct_change("close", "open").alias("ret_oc_pct"),
        pct_change("open", "prev_close").alias("gap_into_t_pct"),
        (ratio(spread, "prev_close") * 100.0).alias("range_pct"),
        ratio(F.col("close") - F.col("low"), spread).alias("close_location"),
        (F.sqrt(log_range * log_range / (4 * math.log(2))) * 100.0).alias("parkinson"),
        F.when(gk.isNotNull(), F.sqrt(F.greatest(gk, F.lit(0.0))) * 100.0).alias("garman_klass"),
    )


def benchmark_gap(df: DataFrame) -> DataFrame:
    gap = pct_change("session_close", "close")
    return df.select("*", gap.alias("bench_gap_pct"), F.abs(gap).alias("bench_gap_abs"))


def log_columns(df: DataFrame) -> DataFrame:
    names = {c: f"log_{c}" for c in
             ("rv_full_pct", "rv_final_30_pct", "rsv_positive", "rsv_negative", "dollar_volume")}
    return df.select("*", *[F.log1p(c).alias(n) for c, n in names.items()])


def calendar_columns(df: DataFrame) -> DataFrame:
    """Gap to the target session, weekday (Monday = 0), long gap and month end (missing target: 1)."""
    gap = F.datediff("target_date", "pred_date")
    same_month = F.coalesce(F.month("pred_date") == F.month("target_date"), F.lit(False))
    return df.select(
        "*", gap.alias("calendar_gap_days"), F.weekday("pred_date").alias("weekday"),
        flag(gap > 1).alias("is_long_gap"), flag(~same_month).alias("month_end"))


def coverage_flag(df: DataFrame, floor: float = 0.8) -> DataFrame:
    return df.withColumn("low_minute_coverage", flag(F.col("minute_coverage") < floor))


def market_by_session(df: DataFrame) -> DataFrame:
    """Cross-sectional aggregates, one row per session."""
    return df.groupBy("pred_date").agg(
        F.avg("ret_oc_pct").alias("mkt_ret_oc"), F.avg("ret_cc_pct").alias("mkt_ret_cc"),
        F.avg("rv_full_pct").alias("mkt_rv"), F.stddev_samp("rv_full_pct").alias("mkt_rv_disp"),
        F.stddev_samp("ret_oc_pct").alias("mkt_ret_disp"),
        F.avg("return_final_60_pct").alias("mkt_final60"),
        F.avg(flag(F.col("ret_oc_pct") > 0)).alias("mkt_breadth_up"),
        F.avg("close_location").alias("mkt_near_high"), F.avg("minute_coverage").alias("mkt_coverage"),
        F.avg("bench_gap_pct").alias("mkt_bench_gap"), F.avg("actual_return_pct").alias("mkt_on"),
    )


def market_lags(market: DataFrame) -> DataFrame:
    """Lagged overnight market history; one row per session, so a single ordered window is fine."""
    w = Window.orderBy("pred_date")
    on = F.col("mkt_on")

    def trail(n, fn, least):
        frame = w.rowsBetween(-n, -1)
        return F.when(F.count(on).over(frame) >= least, fn(on).over(frame))

    seen = F.count(F.lit(1)).over(w.rowsBetween(-19, 0))
    ups = F.coalesce(F.sum(flag(on >= 0)).over(w.rowsBetween(-20, -1)), F.lit(0.0))
    return market.select(
        *[c for c in market.columns if c != "mkt_on"],
        F.lag(on).over(w).alias("mkt_on_lag_1"), F.lag(on, 2).over(w).alias("mkt_on_lag_2"),
        trail(20, F.avg, 10).alias("mkt_on_mean_20"), trail(60, F.avg, 20).alias("mkt_on_mean_60"),
        F.when(seen >= 10, ups / seen).alias("mkt_on_pos_share_20"),
        trail(20, F.stddev_samp, 10).alias("mkt_on_std_20"),
    )


def session_ranks(df: DataFrame, columns: list[str] | None = None,
                  row_keys: tuple[str, ...] = ("symbol", "pred_date")) -> DataFrame:
    """Add cs_rank_*: average-tie percentile among the non-missing values of a session."""
    return average_ranks(df, ["pred_date"], columns or RELATIVE_COLUMNS, list(row_keys), prefix="cs_rank_", percent=True)


def session_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add cs_z_*: distance from the session mean in sample standard deviations."""
    columns = columns or RELATIVE_COLUMNS
    moments = df.groupBy("pred_date").agg(*[
        e for c in columns for e in (F.avg(c).alias(f"_mu_{c}"), F.stddev_samp(c).alias(f"_sd_{c}"))])
    return df.join(moments, "pred_date", "left").select(
        *[df[c] for c in df.columns],
        *[ratio(F.col(c) - F.col(f"_mu_{c}"), f"_sd_{c}").alias(f"cs_z_{c}") for c in columns])


def relative_scores(df: DataFrame, columns: list[str] | None = None,
                    row_keys: tuple[str, ...] = ("symbol", "pred_date")) -> DataFrame:
    """Both of them.  ``df`` should be a staged table: it is scanned for the ranks, the moments and the result."""
    columns = columns or RELATIVE_COLUMNS
    return session_ranks(session_scores(df, columns), columns, row_keys).select(
        *df.columns, *[f"cs_rank_{c}" for c in columns], *[f"cs_z_{c}" for c in columns])


def stock_minus_market(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        (F.col("ret_oc_pct") - F.col("mkt_ret_oc")).alias("stock_minus_mkt_oc"),
        (F.col("rv_full_pct") - F.col("mkt_rv")).alias("stock_minus_mkt_rv"),
        (F.col("return_final_60_pct") - F.col("mkt_final60")).alias("stock_minus_mkt_final60"),
        ratio("rv_full_pct", "mkt_rv").alias("rel_rv_ratio"),
    )


def session_mean(df: DataFrame, value: str, out: str, date_col: str = "pred_date") -> DataFrame:
    """Attach the session mean of ``value``; the staged means are one row per session."""
    means = stage(df.groupBy(date_col).agg(F.avg(value).alias(out)), "session-mean")
    return df.join(means, date_col, "left")


def demeaned(df: DataFrame, value: str = "actual_return_pct", out: str = "resid_target",
             mean: str = "universe_mean_pct") -> DataFrame:
    return session_mean(df, value, mean).withColumn(out, F.col(value) - F.col(mean))


def feature_columns(df: DataFrame, include_benchmark: bool = True) -> list[str]:
    """Sorted numeric model inputs; labels, raw prices and keys are never among them."""
    from pyspark.sql.types import NumericType

    cols = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in NON_FEATURES]
    if not include_benchmark:
        cols = [c for c in cols if "bench_gap" not in c]
    return sorted(cols)
