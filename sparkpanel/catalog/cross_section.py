"""Cross-sectional and calendar features on the daily panel."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import count_nulls, ratio
from ..operators import cross_section as cs, rolling
from ..sources import tables
from ..sources.staging import stage
from .registry import as_long, query, rounded
from .sql import HISTORY, TARGETS, lag, round_all, with_

FACTS = TARGETS + f""",
facts AS (
  SELECT *, (close / prev_close - 1.0) * 100.0 AS ret_cc_pct, (close / open - 1.0) * 100.0 AS ret_oc_pct,
    (open / prev_close - 1.0) * 100.0 AS gap_into_t_pct, (high - low) / prev_close * 100.0 AS range_pct,
    (close - low) / nullif(high - low, 0) AS close_location,
    sqrt(pow(ln(high / low), 2) / (4 * ln(2))) * 100.0 AS parkinson,
    sqrt(greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0)) * 100.0
      AS garman_klass
  FROM (SELECT *, {lag('close')} AS prev_close FROM panel0))"""


def facts(spark, sf):
    return cs.range_volatility(rolling.price_history(tables.target_panel(spark, sf)))


@query("range_volatility", with_(FACTS, "SELECT symbol, pred_date, " + round_all(
    "ret_cc_pct ret_oc_pct gap_into_t_pct range_pct close_location parkinson garman_klass") + " FROM facts"))
def range_volatility(spark, sf):
    return rounded(facts(spark, sf).select(
        "symbol", "pred_date", "ret_cc_pct", "ret_oc_pct", "gap_into_t_pct", "range_pct", "close_location",
        "parkinson", "garman_klass"))


@query("calendar_features", with_(TARGETS, """
SELECT symbol, pred_date, CAST(target_date - pred_date AS BIGINT) AS calendar_gap_days,
  CAST(isodow(pred_date) - 1 AS BIGINT) AS weekday,
  CASE WHEN target_date - pred_date > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_long_gap,
  CASE WHEN month(pred_date) = month(target_date) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS month_end FROM panel0"""))
def calendar_features(spark, sf):
    df = cs.calendar_columns(tables.target_panel(spark, sf))
    return as_long(df.select("symbol", "pred_date", "calendar_gap_days", "weekday", "is_long_gap", "month_end"),
                   "calendar_gap_days", "weekday")


MARKET = FACTS + """,
market AS (
  SELECT pred_date, avg(ret_oc_pct) AS mkt_ret_oc, avg(ret_cc_pct) AS mkt_ret_cc,
    stddev_samp(ret_oc_pct) AS mkt_ret_disp, avg(CASE WHEN ret_oc_pct > 0 THEN 1.0 ELSE 0.0 END) AS mkt_breadth_up,
    avg(close_location) AS mkt_near_high, avg(actual_return_pct) AS mkt_on FROM facts GROUP BY pred_date)"""


def market(spark, sf):
    from ..plans.panel import attach_sessions

    df = attach_sessions(facts(spark, sf), None)
    return cs.market_by_session(cs.benchmark_gap(df))


@query("market_daily", with_(MARKET, "SELECT pred_date, " + round_all(
    "mkt_ret_oc mkt_ret_cc mkt_ret_disp mkt_breadth_up mkt_near_high mkt_on") + " FROM market"))
def market_daily(spark, sf):
    return rounded(market(spark, sf).select(
        "pred_date", "mkt_ret_oc", "mkt_ret_cc", "mkt_ret_disp", "mkt_breadth_up", "mkt_near_high", "mkt_on"))


def _on(n: int, stat: str, least: int) -> str:
    over = f"OVER (ORDER BY pred_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN count(mkt_on) {over} >= {least} THEN {stat}(mkt_on) {over} END, 6)"


@query("market_lags", with_(MARKET, f"""
SELECT pred_date, round(lag(mkt_on) OVER (ORDER BY pred_date), 6) AS mkt_on_lag_1,
  round(lag(mkt_on, 2) OVER (ORDER BY pred_date), 6) AS mkt_on_lag_2,
  {_on(20, 'avg', 10)} AS mkt_on_mean_20, {_on(60, 'avg', 20)} AS mkt_on_mean_60,
  {_on(20, 'stddev_samp', 10)} AS mkt_on_std_20,
  round(CASE WHEN count(*) OVER w >= 10 THEN avg(up) OVER w END, 6) AS mkt_on_pos_share_20
FROM (SELECT *, CASE WHEN lag(mkt_on) OVER (ORDER BY pred_date) >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up
      FROM market)
WINDOW w AS (ORDER BY pred_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def market_lags(spark, sf):
    lags = cs.market_lags(stage(market(spark, sf), "market"))
    return rounded(lags.select("pred_date", *[c for c in lags.columns if c.startswith("mkt_on_")]))


@query("market_broadcast", with_(MARKET, """
SELECT f.symbol, f.pred_date, round(f.ret_oc_pct - m.mkt_ret_oc, 6) AS stock_minus_mkt_oc,
  round(f.ret_oc_pct / nullif(m.mkt_ret_disp, 0), 6) AS rel_move
FROM facts f LEFT JOIN market m ON f.pred_date = m.pred_date"""))
def market_broadcast(spark, sf):
    """Market table back on every row, and the stock-minus-market differences."""
    rows = stage(facts(spark, sf), "facts")
    mkt = stage(market(spark, sf), "market")
    return rounded(rows.join(mkt.drop("mkt_on"), "pred_date", "left").select(
        "symbol", "pred_date", (F.col("ret_oc_pct") - F.col("mkt_ret_oc")).alias("stock_minus_mkt_oc"),
        ratio("ret_oc_pct", "mkt_ret_disp").alias("rel_move")))


CS = ["ret_oc_pct", "ret_cc_pct", "range_pct", "close_location", "actual_magnitude_pct"]


@query("cs_rank", with_(FACTS, "SELECT symbol, pred_date, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN round((rank() OVER (PARTITION BY pred_date ORDER BY {c} ASC NULLS LAST) "
    f"+ (count(*) OVER (PARTITION BY pred_date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY pred_date), 6) END "
    f"AS cs_rank_{c}" for c in CS) + " FROM facts"))
def cs_rank(spark, sf):
    rows = stage(facts(spark, sf).select("symbol", "pred_date", *CS), "facts")
    return rounded(cs.session_ranks(rows, CS).select("symbol", "pred_date", *[f"cs_rank_{c}" for c in CS]))


@query("cs_zscore", with_(FACTS, "SELECT symbol, pred_date, " + ", ".join(
    f"round(({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0), 6) AS cs_z_{c}" for c in CS)
    + " FROM facts WINDOW d AS (PARTITION BY pred_date)"))
def cs_zscore(spark, sf):
    rows = stage(facts(spark, sf).select("symbol", "pred_date", *CS), "facts")
    return rounded(cs.session_scores(rows, CS).select("symbol", "pred_date", *[f"cs_z_{c}" for c in CS]))


@query("demeaned_target", with_(TARGETS, """
SELECT symbol, pred_date, round(avg(actual_return_pct) OVER (PARTITION BY pred_date), 6) AS universe_mean_pct,
  round(actual_return_pct - avg(actual_return_pct) OVER (PARTITION BY pred_date), 6) AS resid_target FROM panel0"""))
def demeaned_target(spark, sf):
    panel = stage(tables.target_panel(spark, sf).select("symbol", "pred_date", "actual_return_pct"), "targets")
    return rounded(cs.demeaned(panel).select("symbol", "pred_date", "universe_mean_pct", "resid_target"))


@query("log_volume", with_(TARGETS, """
SELECT symbol, pred_date, round(ln(1 + close * volume), 6) AS log_dollar_volume,
  CASE WHEN volume / 375.0 < 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS low_minute_coverage FROM panel0"""))
def log_volume(spark, sf):
    df = tables.target_panel(spark, sf).select(
        "symbol", "pred_date", F.log1p(F.col("close") * F.col("volume")).alias("log_dollar_volume"),
        (F.col("volume") / 375.0).alias("minute_coverage"))
    return rounded(cs.coverage_flag(df).drop("minute_coverage"))


MISSING = ["mag_mean_5", "mag_mean_20", "mag_mean_60", "mag_std_20", "mag_median_20", "actual_return_pct"]


@query("missing_count", with_(HISTORY, "SELECT symbol, pred_date, CAST(" + " + ".join(
    f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in MISSING) + " AS BIGINT) AS n_missing FROM hist"))
def missing_count(spark, sf):
    return tables.history_panel(spark, sf).select(
        "symbol", "pred_date", count_nulls(MISSING).cast("bigint").alias("n_missing"))


@query("non_finite_guard", with_(HISTORY, "SELECT " + ", ".join(
    f"count(*) FILTER ({c} IS NULL OR isnan({c}) OR isinf({c})) AS {c}" for c in MISSING) + " FROM hist"))
def non_finite_guard(spark, sf):
    from ..operators.quality import non_finite_counts

    return non_finite_counts(tables.history_panel(spark, sf), MISSING)
