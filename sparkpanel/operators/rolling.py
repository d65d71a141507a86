"""Per-symbol history operators.

(symbol, pred_date) is unique, so a symbol has at most one row per calendar session:
every window partition here is bounded by the calendar, not by the data volume.  All
operators share the same partitioning and ordering, hence one shuffle and one sort.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.columns import col, flag, pct_change, ratio


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("pred_date")


_STATS = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum,
    "median": lambda c: F.percentile(c, 0.5),
}


def prior(n: int, order: WindowSpec | None = None):
    """The n rows before the current one."""
    return (order or by_symbol()).rowsBetween(-n, -1)


def trailing(c: str | Column, n: int, stat: str, min_periods: int, order: WindowSpec | None = None) -> Column:
    """Statistic of the previous n rows; null unless min_periods of them are present."""
    w, c = prior(n, order), col(c)
    return F.when(F.count(c).over(w) >= min_periods, _STATS[stat](c).over(w))


def lag_return(c: str, k: int, order: WindowSpec | None = None) -> Column:
    return pct_change(c, F.lag(c, k).over(order or by_symbol()))


def trailing_up_share(c: str, n: int, min_periods: int, order: WindowSpec | None = None) -> Column:
    """Share of the last n lagged values that are >= 0; a missing one counts as down."""
    order = order or by_symbol()
    w = order.rowsBetween(-n, -1)
    # the current row always contributes a lagged slot, even on the first row of a symbol
    seen = F.count(F.lit(1)).over(order.rowsBetween(-(n - 1), 0))
    ups = F.coalesce(F.sum(flag(col(c) >= 0)).over(w), F.lit(0.0))
    return F.when(seen >= min_periods, ups / seen)


def trailing_pct_rank(c: str, n: int, min_periods: int, order: WindowSpec | None = None) -> Column:
    """Average-tie percentile of the lagged value among the previous n values."""
    order = order or by_symbol()
    values = F.collect_list(c).over(prior(n, order))
    last = F.lag(c).over(order)
    less = F.size(F.filter(values, lambda v: v < last))
    same = F.size(F.filter(values, lambda v: v == last))
    size = F.size(values)
    return F.when(last.isNotNull() & (size >= min_periods), (less + (same + 1) / 2.0) / size)


def sign_streak(df: DataFrame, c: str, out: str) -> DataFrame:
    """Length so far of the current run of equal signs of the lagged value (missing is down)."""
    df = df.withColumn("_up", F.coalesce(F.lag(c).over(by_symbol()) >= 0, F.lit(False)))
    prev = F.coalesce(F.lag("_up").over(by_symbol()), F.lit(False))
    df = df.withColumn("_run", F.sum((F.col("_up") != prev).cast("int")).over(
        by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("symbol", "_run").orderBy("pred_date")
    return df.withColumn(out, F.row_number().over(run)).drop("_up", "_run")


def trailing_ewm(df: DataFrame, c: str, out: str, halflife: float = 20, min_periods: int = 10) -> DataFrame:
    """Exponentially weighted mean of lagged values, recursive form; the past's weight decays through missing values too.

    A value x that comes g rows after the one before gives y = keep * y_before + (1 - keep) * x with keep = w / (w + alpha)
    and w = (1 - alpha)^g.  Such a recurrence is a prefix sum of (1 - keep) * x over the running product of ``keep``.  The
    product restarts after 60 halvings, far from the ends of the number range, and takes the last mean along: what is
    older than the block before has lost all weight that a double can show.
    """
    alpha = 1.0 - 0.5 ** (1.0 / halflife)
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    block = Window.partitionBy("symbol", "_block").orderBy("pred_date").rowsBetween(Window.unboundedPreceding, 0)
    missing = F.lit(None).cast("double")
    df = df.withColumn("_x", F.lag(F.nanvl(F.col(c).cast("double"), missing)).over(by_symbol())).withColumns({
        "_row": F.row_number().over(by_symbol()), "_n": F.count("_x").over(upto)})
    known = F.col("_x").isNotNull()
    w = F.pow(F.lit(1.0 - alpha), F.col("_row") - F.last(F.when(known, F.col("_row")), ignorenulls=True).over(earlier))
    # the first value takes nothing over: it weighs 1 and leaves the product as it is
    df = df.withColumn("_keep", F.when(known & (F.col("_n") > 1), F.greatest(w / (w + alpha), F.lit(2.0 ** -80))))
    df = df.withColumn("_block", F.floor(F.sum(F.coalesce(-F.log2("_keep"), F.lit(0.0))).over(upto) / 60))
    df = df.withColumn("_left", F.product(F.coalesce("_keep", F.lit(1.0))).over(block))
    weight = F.when(F.col("_n") > 1, 1.0 - F.col("_keep")).otherwise(1.0)
    df = df.withColumn("_own", F.col("_left") * F.sum(weight * F.col("_x") / F.col("_left")).over(block))
    fresh = F.col("_block") != F.lag("_block").over(by_symbol())
    df = df.withColumn("_taken", F.when(fresh, F.lag("_own").over(by_symbol())))
    mean = F.col("_own") + F.coalesce(F.col("_left") * F.first("_taken").over(block), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("_n") >= min_periods, mean)).drop(
        "_x", "_row", "_n", "_keep", "_block", "_left", "_own", "_taken")


def history_columns() -> list[Column]:
    n = F.row_number().over(by_symbol()) - 1
    return [n.alias("history_count"), flag(n < 60).alias("is_new_listing")]


def vol_baseline(df: DataFrame) -> DataFrame:
    """Mean of the previous 20 magnitudes, all 20 required."""
    return df.withColumn("vol_baseline_20", trailing("actual_magnitude_pct", 20, "mean", 20))


def error_history(df: DataFrame, err: str = "oof_abs_error") -> DataFrame:
    """Strictly lagged mean and deviation of a symbol's own absolute errors."""
    return df.select(
        "*", trailing(err, 20, "mean", 5).alias("err_hist_mean_20"),
        trailing(err, 20, "std", 5).alias("err_hist_std_20"))


def overnight_history(df: DataFrame) -> DataFrame:
    """Lagged target history: lags, means, deviations, up shares, median (streak and ewm are separate)."""
    cols = [
        F.lag("actual_magnitude_pct").over(by_symbol()).alias("mag_lag_1"),
        F.lag("actual_return_pct").over(by_symbol()).alias("ret_lag_1"),
        F.lag("actual_return_pct", 2).over(by_symbol()).alias("ret_lag_2"),
    ]
    for n in (5, 20, 60):
        m = max(3, n // 2)
        cols += [
            trailing("actual_magnitude_pct", n, "mean", m).alias(f"mag_mean_{n}"),
            trailing("actual_magnitude_pct", n, "std", m).alias(f"mag_std_{n}"),
            trailing("actual_return_pct", n, "mean", m).alias(f"on_mean_{n}"),
            trailing_up_share("actual_return_pct", n, m).alias(f"on_pos_share_{n}"),
        ]
    cols.append(trailing("actual_magnitude_pct", 20, "median", 10).alias("mag_median_20"))
    return df.select("*", *cols)


def price_history(df: DataFrame) -> DataFrame:
    """Previous close, k-day returns and distance to the earlier 20-row extremes."""
    return df.select(
        "*",
        F.lag("close").over(by_symbol()).alias("prev_close"),
        *[lag_return("close", k).alias(f"ret_{k}d_pct") for k in (2, 5, 20)],
        pct_change("close", trailing("high", 20, "max", 10)).alias("dist_20d_high_pct"),
        pct_change("close", trailing("low", 20, "min", 10)).alias("dist_20d_low_pct"),
    )


def liquidity_history(df: DataFrame) -> DataFrame:
    """Realised-volatility and liquidity history; needs ret_cc_pct, range_pct and session columns."""
    illiquidity = ratio(F.abs("ret_cc_pct"), F.col("dollar_volume") / 1e7)
    df = df.withColumn("_illiq", illiquidity)
    return df.select(
        *[c for c in df.columns if c != "_illiq"],
        trailing_pct_rank("range_pct", 60, 20).alias("range_pct_rank_60"),
        ratio("rv_final_30_pct", "rv_full_pct").alias("rv_ratio_final30"),
        ratio(F.col("rv_full_pct") - trailing("rv_full_pct", 60, "mean", 20),
              trailing("rv_full_pct", 60, "std", 20)).alias("rv_z_60"),
        trailing("rv_full_pct", 20, "std", 10).alias("rv_of_rv_20"),
        trailing("rv_full_pct", 20, "mean", 10).alias("rv_mean_20"),
        ratio("total_volume", trailing("total_volume", 20, "mean", 10)).alias("volume_ratio_20"),
        trailing("_illiq", 20, "mean", 10).alias("amihud_20"),
        (trailing("dollar_volume", 20, "mean", 10) / 1e7).alias("adv_20_cr"),
    )
