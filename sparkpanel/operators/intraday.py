"""Intraday bars: session filter, anchored buckets, bucket bars and session features.

Every step is a map-side combined aggregate on (symbol, date, bucket) or
(symbol, date); the only window runs over the at most 75 buckets of one session.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import flag, pct_change, positive_log, ratio

# fixed values: the session and its buckets
OPEN_MINUTE = 9 * 60 + 15
CLOSE_MINUTE = 15 * 60 + 29
BUCKET_MINUTES = 5
LAST_BUCKET = 74
EXPECTED_BARS = 375

# fixed values: session features that enter the feature panel
SESSION_COLUMNS = [
    "session_open", "session_high", "session_low", "session_close",
    "rv_full_pct", "rv_morning_pct", "rv_afternoon_pct", "rv_final_60_pct", "rv_final_30_pct",
    "rsv_positive", "rsv_negative", "semivariance_imbalance",
    "return_first_hour_pct", "return_final_60_pct", "return_final_30_pct", "return_final_15_pct",
    "return_1400_close_pct", "trend_slope_pct", "path_efficiency", "path_length",
    "close_vs_vwap_pct", "vwap", "high_time_fraction", "low_time_fraction",
    "max_5m_return", "min_5m_return", "max_abs_5m_return", "positive_5m_share",
    "first_hour_volume_share", "final_60_volume_share", "final_30_volume_share",
    "final_15_volume_share", "max_5m_volume_share",
    "total_volume", "dollar_volume", "minute_coverage", "incomplete_5m_buckets",
]


def minute_of_day(ts="timestamp"):
    return F.hour(ts) * 60 + F.minute(ts)


def in_session(bars: DataFrame, first: int = OPEN_MINUTE, last: int = CLOSE_MINUTE) -> DataFrame:
    return bars.where(minute_of_day().between(first, last))


def with_bucket(bars: DataFrame, anchor: int = OPEN_MINUTE, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Add the calendar date and the bucket number counted from the anchor minute."""
    return bars.withColumn("date", F.to_date("timestamp")).withColumn(
        "bucket", F.floor((minute_of_day() - anchor) / minutes).cast("smallint"))


def bucket_bars(bars: DataFrame, extra_keys: list | None = None) -> DataFrame:
    """First open, highest high, lowest low, last close, summed volume, bar count; gaps are kept."""
    return bars.groupBy("symbol", "date", "bucket", *(extra_keys or [])).agg(
        F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.count(F.lit(1)).alias("minute_count"),
    )


def five_minute_bars(bars: DataFrame) -> DataFrame:
    return bucket_bars(with_bucket(in_session(bars)))


def bucket_returns(five: DataFrame) -> DataFrame:
    """Log return against the previous bucket of the session (its own open for the first one)."""
    w = Window.partitionBy("symbol", "date").orderBy("bucket")
    five = five.withColumn("prev_close", F.coalesce(F.lag("close").over(w), F.col("open")))
    r = F.when((F.col("close") > 0) & (F.col("prev_close") > 0), F.ln(ratio("close", "prev_close")))
    five = five.withColumn("log_ret", r).withColumn("ret_sq", F.col("log_ret") * F.col("log_ret"))
    return five.select(
        "*",
        F.when(F.col("log_ret") > 0, F.col("ret_sq")).otherwise(0.0).alias("pos_sq"),
        F.when(F.col("log_ret") < 0, F.col("ret_sq")).otherwise(0.0).alias("neg_sq"),
        F.abs(F.col("close") - F.col("prev_close")).alias("abs_path"),
        (F.col("close") * F.coalesce("volume", F.lit(0.0))).alias("dollar_volume"),
    )


def session_features(five: DataFrame, expected_bars: int = EXPECTED_BARS) -> DataFrame:
    """One row per (symbol, session) from bucket bars; the column is called pred_date."""
    b = F.col("bucket")
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)))
    close_at = lambda k: F.max(F.when(b == k, F.col("close")))
    x = b / float(LAST_BUCKET)
    agg = bucket_returns(five).groupBy("symbol", "date").agg(
        F.min_by("open", "bucket").alias("session_open"), F.max("high").alias("session_high"),
        F.min("low").alias("session_low"), F.max_by("close", "bucket").alias("session_close"),
        F.sum("minute_count").alias("minute_bar_count"), F.count(F.lit(1)).alias("five_min_bar_count"),
        F.sum("volume").alias("total_volume"), F.coalesce(F.sum("abs_path"), F.lit(0.0)).alias("path_length"),
        (F.max("log_ret") * 100.0).alias("max_5m_return"), (F.min("log_ret") * 100.0).alias("min_5m_return"),
        (F.max(F.abs("log_ret")) * 100.0).alias("max_abs_5m_return"),
        F.avg(flag(F.col("log_ret") > 0)).alias("positive_5m_share"),
        F.sum("pos_sq").alias("_pos"), F.sum("neg_sq").alias("_neg"),
        F.coalesce(F.sum("dollar_volume"), F.lit(0.0)).alias("dollar_volume"),
        F.sum("ret_sq").alias("_rv"), total(b < 39, "ret_sq").alias("_rv_am"),
        total(b >= 39, "ret_sq").alias("_rv_pm"), total(b >= 63, "ret_sq").alias("_rv_60"),
        total(b >= 69, "ret_sq").alias("_rv_30"),
        total(b < 12, "volume").alias("_v_first"), total(b >= 63, "volume").alias("_v_60"),
        total(b >= 69, "volume").alias("_v_30"), total(b >= 72, "volume").alias("_v_15"),
        F.max("volume").alias("_v_max"),
        close_at(71).alias("_c15"), close_at(68).alias("_c30"), close_at(62).alias("_c60"),
        close_at(56).alias("_c1400"), close_at(11).alias("_c_first"),
        F.max_by("bucket", F.struct(F.col("high"), -b)).alias("_high_at"),
        F.min_by("bucket", F.struct(F.col("low"), b)).alias("_low_at"),
        F.regr_slope(positive_log("close"), x).alias("_slope"),
        F.count_if(F.col("minute_count") < 5).alias("incomplete_5m_buckets"),
    )
    root = lambda c: F.sqrt(c) * 100.0
    imbalance = ratio(F.col("_pos") - F.col("_neg"), F.col("_pos") + F.col("_neg"))
    agg = agg.withColumn("vwap", ratio("dollar_volume", "total_volume"))
    return agg.select(
        "symbol", F.col("date").alias("pred_date"),
        "session_open", "session_high", "session_low", "session_close",
        "minute_bar_count", "five_min_bar_count", "total_volume", "path_length",
        "max_5m_return", "min_5m_return", "max_abs_5m_return", "positive_5m_share",
        root("_pos").alias("rsv_positive"), root("_neg").alias("rsv_negative"), "dollar_volume",
        root("_rv").alias("rv_full_pct"), root("_rv_am").alias("rv_morning_pct"),
        root("_rv_pm").alias("rv_afternoon_pct"), root("_rv_60").alias("rv_final_60_pct"),
        root("_rv_30").alias("rv_final_30_pct"),
        ratio("_v_first", "total_volume").alias("first_hour_volume_share"),
        ratio("_v_60", "total_volume").alias("final_60_volume_share"),
        ratio("_v_30", "total_volume").alias("final_30_volume_share"),
        ratio("_v_15", "total_volume").alias("final_15_volume_share"),
        ratio("_v_max", "total_volume").alias("max_5m_volume_share"),
        pct_change("session_close", "_c15").alias("return_final_15_pct"),
        pct_change("session_close", "_c30").alias("return_final_30_pct"),
        pct_change("session_close", "_c60").alias("return_final_60_pct"),
        pct_change("session_close", "_c1400").alias("return_1400_close_pct"),
        pct_change("_c_first", "session_open").alias("return_first_hour_pct"),
        (F.col("_high_at") / float(LAST_BUCKET)).alias("high_time_fraction"),
        (F.col("_low_at") / float(LAST_BUCKET)).alias("low_time_fraction"),
        "vwap", pct_change("session_close", "vwap").alias("close_vs_vwap_pct"),
        ratio(F.abs(F.col("session_close") - F.col("session_open")), "path_length").alias("path_efficiency"),
        (F.col("_slope") * 100.0).alias("trend_slope_pct"),
        imbalance.alias("semivariance_imbalance"),
        (F.col("minute_bar_count") / float(expected_bars)).alias("minute_coverage"),
        "incomplete_5m_buckets",
    )
