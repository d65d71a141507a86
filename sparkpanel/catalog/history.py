"""Per-symbol history operators on the daily panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import pct_change, ratio
from ..operators import rolling
from ..operators.rolling import trailing
from ..sources import tables
from .registry import as_long, query, rounded
from .sql import HISTORY, TARGETS, lag, round_all, trailing as sql_trailing, with_

KEYS = ["symbol", "pred_date"]


def history_query(name: str, select: str, columns: str, exact: str = ""):
    """A query whose SQL selects ``columns`` (name -> expression) over the target panel."""
    kept = "".join(f", {c}" for c in exact.split())
    sql = with_(TARGETS, f"SELECT symbol, pred_date, {round_all(columns)}{kept} FROM ({select})")

    def register(fn):
        @query(name, sql)
        def run(spark, sf):
            wide = fn(tables.target_panel(spark, sf)).select(*KEYS, *columns.split(), *exact.split())
            return rounded(wide, keep=tuple(exact.split()))
        return fn
    return register


@history_query("lag_returns", f"""
SELECT *, {lag('close')} AS prev_close, (close / {lag('close', 2)} - 1.0) * 100.0 AS ret_2d_pct,
  (close / {lag('close', 5)} - 1.0) * 100.0 AS ret_5d_pct, (close / {lag('close', 20)} - 1.0) * 100.0 AS ret_20d_pct,
  {lag('actual_magnitude_pct')} AS mag_lag_1, {lag('actual_return_pct')} AS ret_lag_1,
  {lag('actual_return_pct', 2)} AS ret_lag_2 FROM panel0""",
               "ret_2d_pct ret_5d_pct ret_20d_pct mag_lag_1 ret_lag_1 ret_lag_2", exact="prev_close")
def lag_returns(panel):
    return rolling.price_history(rolling.overnight_history(panel))


@history_query("rolling_mean_std", "SELECT *, " + ", ".join(
    f"{sql_trailing('actual_magnitude_pct', n, 'avg({})', m)} AS mag_mean_{n}, "
    f"{sql_trailing('actual_magnitude_pct', n, 'stddev_samp({})', m)} AS mag_std_{n}, "
    f"{sql_trailing('actual_return_pct', n, 'avg({})', m)} AS on_mean_{n}"
    for n, m in ((5, 3), (20, 10), (60, 30))) + " FROM panel0",
               "mag_mean_5 mag_std_5 on_mean_5 mag_mean_20 mag_std_20 on_mean_20 mag_mean_60 mag_std_60 on_mean_60")
def rolling_mean_std(panel):
    return rolling.overnight_history(panel)


@history_query("rolling_extremes", f"""
SELECT *, (close / ({sql_trailing('high', 20, 'max({})', 10)}) - 1.0) * 100.0 AS dist_20d_high_pct,
  (close / ({sql_trailing('low', 20, 'min({})', 10)}) - 1.0) * 100.0 AS dist_20d_low_pct FROM panel0""",
               "dist_20d_high_pct dist_20d_low_pct")
def rolling_extremes(panel):
    return rolling.price_history(panel)


@history_query("rolling_median", f"""
SELECT *, {sql_trailing('actual_magnitude_pct', 20, 'quantile_cont({}, 0.5)', 10)} AS mag_median_20 FROM panel0""",
               "mag_median_20")
def rolling_median(panel):
    return rolling.overnight_history(panel)


@history_query("rolling_up_share", "SELECT *, " + ", ".join(
    f"CASE WHEN count(*) OVER w{n} >= {m} THEN avg(up) OVER w{n} END AS on_pos_share_{n}"
    for n, m in ((5, 3), (20, 10), (60, 30))) + f"""
 FROM (SELECT *, CASE WHEN {lag('actual_return_pct')} >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up FROM panel0)
 WINDOW w5 AS (PARTITION BY symbol ORDER BY pred_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
   w20 AS (PARTITION BY symbol ORDER BY pred_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
   w60 AS (PARTITION BY symbol ORDER BY pred_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
               "on_pos_share_5 on_pos_share_20 on_pos_share_60")
def rolling_up_share(panel):
    return rolling.overnight_history(panel)


@history_query("rolling_pct_rank", f"""
SELECT *, CASE WHEN len(v) >= 20 AND last IS NOT NULL THEN (len(list_filter(v, lambda x: x < last))
    + (len(list_filter(v, lambda x: x = last)) + 1) / 2.0) / len(v) END AS range_pct_rank_60
FROM (SELECT *, lag(range_pct) OVER (PARTITION BY symbol ORDER BY pred_date) AS last,
        list_filter(list(range_pct) OVER (PARTITION BY symbol ORDER BY pred_date
                    ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS v
      FROM (SELECT *, (high - low) / nullif({lag('close')}, 0) * 100.0 AS range_pct FROM panel0))""",
               "range_pct_rank_60")
def rolling_pct_rank(panel):
    ranged = rolling.price_history(panel).withColumn(
        "range_pct", ratio(F.col("high") - F.col("low"), "prev_close") * 100.0)
    return ranged.withColumn("range_pct_rank_60", rolling.trailing_pct_rank("range_pct", 60, 20))


@history_query("sign_streak", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY pred_date) AS DOUBLE) AS on_sign_streak
FROM (SELECT *, sum(change) OVER o AS run
      FROM (SELECT *, CASE WHEN up <> coalesce(lag(up) OVER o, false) THEN 1 ELSE 0 END AS change
            FROM (SELECT *, coalesce({lag('actual_return_pct')} >= 0, false) AS up FROM panel0)
            WINDOW o AS (PARTITION BY symbol ORDER BY pred_date))
      WINDOW o AS (PARTITION BY symbol ORDER BY pred_date))""", "on_sign_streak")
def sign_streak(panel):
    return rolling.sign_streak(panel, "actual_return_pct", "on_sign_streak").withColumn(
        "on_sign_streak", F.col("on_sign_streak").cast("double"))


@history_query("amihud", f"""
SELECT *, {sql_trailing('illiq', 20, 'avg({})', 10)} AS amihud_20,
  ({sql_trailing('dv', 20, 'avg({})', 10)}) / 1e7 AS adv_20_cr,
  volume / nullif({sql_trailing('volume', 20, 'avg({})', 10)}, 0) AS volume_ratio_20
FROM (SELECT *, close * volume AS dv,
        abs((close / {lag('close')} - 1.0) * 100.0) / nullif(close * volume / 1e7, 0) AS illiq FROM panel0)""",
               "amihud_20 adv_20_cr volume_ratio_20")
def amihud(panel):
    """Illiquidity, average dollar volume and volume ratio on daily dollar volume."""
    df = rolling.price_history(panel).withColumn("dollar_volume", F.col("close") * F.col("volume"))
    df = df.withColumn("illiq", ratio(F.abs(pct_change("close", "prev_close")), F.col("dollar_volume") / 1e7))
    return df.select(
        "*", trailing("illiq", 20, "mean", 10).alias("amihud_20"),
        (trailing("dollar_volume", 20, "mean", 10) / 1e7).alias("adv_20_cr"),
        ratio("volume", trailing("volume", 20, "mean", 10)).alias("volume_ratio_20"))


@query("history_count", with_(TARGETS, """
SELECT symbol, pred_date, row_number() OVER (PARTITION BY symbol ORDER BY pred_date) - 1 AS history_count,
  CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY pred_date) - 1 < 60 THEN 1.0::DOUBLE
       ELSE 0.0::DOUBLE END AS is_new_listing FROM panel0"""))
def history_count(spark, sf):
    return as_long(tables.target_panel(spark, sf).select(*KEYS, *rolling.history_columns()), "history_count")


@query("vol_baseline", with_(TARGETS, f"""
SELECT symbol, pred_date, round({sql_trailing('actual_magnitude_pct', 20, 'avg({})', 20)}, 6) AS vol_baseline_20
FROM panel0"""))
def vol_baseline(spark, sf):
    return rounded(rolling.vol_baseline(tables.target_panel(spark, sf)).select(*KEYS, "vol_baseline_20"))


@query("rv_history", with_(TARGETS, f"""
SELECT symbol, pred_date,
  round((rv - {sql_trailing('rv', 60, 'avg({})', 20)}) / nullif({sql_trailing('rv', 60, 'stddev_samp({})', 20)}, 0), 6)
    AS rv_z_60,
  round({sql_trailing('rv', 20, 'stddev_samp({})', 10)}, 6) AS rv_of_rv_20,
  round({sql_trailing('rv', 20, 'avg({})', 10)}, 6) AS rv_mean_20
FROM (SELECT *, (high - low) / low * 100.0 AS rv FROM panel0)"""))
def rv_history(spark, sf):
    """Standardised volatility history; the daily range stands in for the realised volatility."""
    df = tables.target_panel(spark, sf).withColumn("rv_full_pct", ratio(F.col("high") - F.col("low"), "low") * 100.0)
    rv = "rv_full_pct"
    return rounded(df.select(
        *KEYS,
        ratio(F.col(rv) - trailing(rv, 60, "mean", 20), trailing(rv, 60, "std", 20)).alias("rv_z_60"),
        trailing(rv, 20, "std", 10).alias("rv_of_rv_20"), trailing(rv, 20, "mean", 10).alias("rv_mean_20")))


@query("ewm_magnitude", "WITH RECURSIVE " + TARGETS + """,
ordered AS (
  SELECT symbol, pred_date, lag(actual_magnitude_pct) OVER (PARTITION BY symbol ORDER BY pred_date) AS x,
         row_number() OVER (PARTITION BY symbol ORDER BY pred_date) AS i FROM panel0),
walk AS (
  SELECT symbol, i, pred_date, x AS y, 1.0::DOUBLE AS w, CASE WHEN x IS NULL THEN 0 ELSE 1 END AS seen
  FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.symbol, o.i, o.pred_date,
    CASE WHEN t.y IS NULL THEN o.x WHEN o.x IS NULL THEN t.y
         ELSE (t.w * pow(2, -1.0 / 20) * t.y + (1 - pow(2, -1.0 / 20)) * o.x)
              / (t.w * pow(2, -1.0 / 20) + 1 - pow(2, -1.0 / 20)) END,
    CASE WHEN t.y IS NULL OR o.x IS NOT NULL THEN 1.0::DOUBLE ELSE t.w * pow(2, -1.0 / 20) END,
    t.seen + CASE WHEN o.x IS NULL THEN 0 ELSE 1 END
  FROM walk t JOIN ordered o ON o.symbol = t.symbol AND o.i = t.i + 1)
SELECT symbol, pred_date, CASE WHEN seen >= 10 THEN round(y, 6) END AS mag_ewm_20 FROM walk""")
def ewm_magnitude(spark, sf):
    panel = tables.target_panel(spark, sf).select(*KEYS, "actual_magnitude_pct")
    return rounded(rolling.trailing_ewm(panel, "actual_magnitude_pct", "mag_ewm_20").select(*KEYS, "mag_ewm_20"))


@query("error_history", with_(HISTORY, f"""
SELECT symbol, pred_date, round({sql_trailing('err', 20, 'avg({})', 5)}, 6) AS err_hist_mean_20,
  round({sql_trailing('err', 20, 'stddev_samp({})', 5)}, 6) AS err_hist_std_20
FROM (SELECT *, abs(mag_mean_20 - actual_magnitude_pct) AS err FROM hist)"""))
def error_history(spark, sf):
    df = tables.history_panel(spark, sf).withColumn(
        "oof_abs_error", F.abs(F.col("mag_mean_20") - F.col("actual_magnitude_pct")))
    return rounded(rolling.error_history(df).select(*KEYS, "err_hist_mean_20", "err_hist_std_20"))
