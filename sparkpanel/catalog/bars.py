"""Bars, calendar, targets, splits, folds and session features."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal, intraday
from ..sources import tables
from ..sources.staging import stage
from .registry import as_long, query, rounded
from .sql import DAILY, EVENT_BARS, SESSIONS, SPLITS, TARGETS, round_all, with_


@query("daily_bars", with_(DAILY, "SELECT symbol, date, open, high, low, close, volume FROM daily"))
def daily_bars(spark, sf):
    return tables.daily_bars(spark, sf)


@query("duplicate_key_check", with_(DAILY, """
SELECT symbol, date, count(*) AS n_rows FROM trades GROUP BY symbol, date HAVING count(*) > 1"""))
def duplicate_key_check(spark, sf):
    return cal.duplicate_keys(tables.trade_ticks(spark, sf), ["symbol", "date"])


@query("master_calendar", with_(DAILY, "SELECT session, session_idx, next_session FROM calendar"))
def master_calendar(spark, sf):
    return as_long(cal.session_calendar(tables.daily_bars(spark, sf)), "session_idx")


@query("overnight_target", with_(TARGETS, """
SELECT symbol, pred_date, target_date, target_open, target_close, round(actual_return_pct, 6) AS actual_return_pct,
       round(actual_magnitude_pct, 6) AS actual_magnitude_pct, actual_direction FROM panel0"""))
def overnight_target(spark, sf):
    return rounded(tables.target_panel(spark, sf).select(
        "symbol", "pred_date", "target_date", "target_open", "target_close",
        "actual_return_pct", "actual_magnitude_pct", "actual_direction"), keep=("target_open", "target_close"))


@query("unscorable_by_symbol", with_(TARGETS, """
SELECT symbol, count(*) AS n_rows, count(actual_return_pct) AS scorable,
       count(*) - count(actual_return_pct) AS unscorable FROM panel0 GROUP BY symbol"""))
def unscorable_by_symbol(spark, sf):
    n, ok = F.count(F.lit(1)), F.count("actual_return_pct")
    return tables.target_panel(spark, sf).groupBy("symbol").agg(
        n.alias("n_rows"), ok.alias("scorable"), (n - ok).alias("unscorable"))


@query("embargoed_splits", with_(SPLITS, """
SELECT train_end, valid_start, valid_end, test_start,
       (SELECT list(session ORDER BY session) FROM calendar, edges WHERE session_idx > tr AND session_idx <= tr + 5)
         AS train_valid_embargo,
       (SELECT list(session ORDER BY session) FROM calendar, edges WHERE session_idx > va AND session_idx <= va + 5)
         AS valid_test_embargo
FROM bounds"""))
def embargoed_splits(spark, sf):
    _, calendar = tables.daily_with_calendar(spark, sf)
    return cal.split_bounds_table(calendar, tables.TRAIN_END, tables.VALID_END, tables.EMBARGO)


@query("split_coverage", with_(SPLITS, """
SELECT split, count(*) AS n_rows, count(DISTINCT pred_date) AS sessions, count(DISTINCT symbol) AS symbols,
       min(pred_date) AS first_date, max(pred_date) AS last_date
FROM panel WHERE actual_return_pct IS NOT NULL GROUP BY split"""))
def split_coverage(spark, sf):
    return cal.split_coverage(tables.history_panel(spark, sf).where("actual_return_pct is not null"))


@query("test_quarantine", with_(SPLITS, """
SELECT symbol, count(*) AS n_rows, count(split) AS labelled, max(pred_date) AS last_date, max(target_date) AS last_target
FROM panel, bounds WHERE pred_date < test_start GROUP BY symbol"""))
def test_quarantine(spark, sf):
    daily, calendar = tables.daily_with_calendar(spark, sf)
    bounds = cal.split_bounds(calendar, tables.TRAIN_END, tables.VALID_END, tables.EMBARGO)
    early = cal.quarantine(daily, "research", bounds.test_start, "date")
    panel = cal.label_splits(cal.overnight_targets(early, calendar), bounds)
    return cal.quarantine(panel, "research").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("split").alias("labelled"),
        F.max("pred_date").alias("last_date"), F.max("target_date").alias("last_target"))


@query("scorable_row_counts", with_(SPLITS, """
SELECT split, count(*) AS n_rows FROM panel
WHERE actual_return_pct IS NOT NULL AND split IS NOT NULL AND history_count >= 20 GROUP BY split"""))
def scorable_row_counts(spark, sf):
    return cal.scorable_rows(tables.history_panel(spark, sf)).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


FOLDS = SPLITS + """,
sessions_tr AS (
  SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT pred_date AS session FROM panel
        WHERE actual_return_pct IS NOT NULL AND split = 'train' AND history_count >= 20)),
blocks AS (
  SELECT fold, min(session) AS predict_start, max(session) AS predict_end, min(i) AS first_i
  FROM (SELECT *, ntile(5) OVER (ORDER BY session) AS fold FROM sessions_tr WHERE i >= n - 657) GROUP BY fold),
folds AS (
  SELECT CAST(b.fold AS INTEGER) AS fold, s.session AS train_end, predict_start, predict_end,
    (SELECT list(session ORDER BY session) FROM sessions_tr WHERE i >= b.first_i - 5 AND i < b.first_i)
      AS embargo_sessions
  FROM blocks b JOIN sessions_tr s ON s.i = b.first_i - 6)"""


def train_sessions(panel):
    rows = cal.scorable_rows(panel).where("split = 'train'")
    return rows.select(F.col("pred_date").alias("session")).distinct()


@query("expanding_folds", with_(FOLDS, "SELECT * FROM folds"))
def expanding_folds(spark, sf):
    return cal.expanding_folds(train_sessions(tables.history_panel(spark, sf)), 5, 657, 5)


@query("fold_membership_counts", with_(FOLDS, """
SELECT fold, CASE WHEN pred_date <= train_end THEN 'train' ELSE 'predict' END AS role, count(*) AS n_rows
FROM panel, folds WHERE actual_return_pct IS NOT NULL AND split = 'train' AND history_count >= 20
  AND (pred_date <= train_end OR pred_date BETWEEN predict_start AND predict_end) GROUP BY ALL"""))
def fold_membership_counts(spark, sf):
    panel = stage(tables.history_panel(spark, sf).select(
        "symbol", "pred_date", "split", "actual_return_pct", "history_count"), "fold-panel")
    folds = stage(cal.expanding_folds(train_sessions(panel), 5, 657, 5), "folds")
    rows = cal.scorable_rows(panel).where("split = 'train'")
    return cal.fold_membership(rows, folds).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"))


@query("fold_overlap_check", with_(FOLDS, """
SELECT fold, count(*) FILTER (session <= train_end AND session BETWEEN predict_start AND predict_end)
         AS overlap_sessions,
       count(*) FILTER (session > train_end AND session < predict_start) AS gap_sessions
FROM sessions_tr, folds GROUP BY fold HAVING overlap_sessions > 0 OR gap_sessions < 6"""))
def fold_overlap_check(spark, sf):
    """Folds with fewer than six sessions between training and prediction (five are reserved)."""
    sessions = stage(train_sessions(tables.history_panel(spark, sf)), "train-sessions")
    folds = stage(cal.expanding_folds(sessions, 5, 657, 5), "folds")
    return cal.fold_violations(sessions, folds, 6)


@query("chronological_cut", with_(SPLITS, """
SELECT make_timestamp(CAST(quantile_cont(CAST(epoch_us(pred_date) AS DOUBLE), 0.8) AS BIGINT)) AS cut
FROM panel WHERE actual_return_pct IS NOT NULL AND split = 'train'"""))
def chronological_cut(spark, sf):
    rows = tables.history_panel(spark, sf).where("actual_return_pct is not null and split = 'train'")
    return cal.chronological_cut(rows)


@query("minute_bars", with_(EVENT_BARS, "SELECT * FROM minutes", symbol="event_type"))
def minute_bars(spark, sf):
    return tables.minute_bars(spark, sf)


@query("five_minute_bars", with_(EVENT_BARS, "SELECT * FROM five", symbol="event_type"))
def five_minute_bars(spark, sf):
    return intraday.five_minute_bars(tables.minute_bars(spark, sf))


def session_query(name: str, columns: str, by: str = "event_type", digits: int = 6):
    sql = with_(SESSIONS, f"SELECT symbol, pred_date, {round_all(columns, digits)} FROM sessions", symbol=by)

    @query(name, sql)
    def run(spark, sf):
        five = intraday.five_minute_bars(tables.minute_bars(spark, sf, by))
        wide = intraday.session_features(five).select("symbol", "pred_date", *columns.split())
        return rounded(wide, digits)
    return run


session_query("session_features", "session_open session_high session_low session_close total_volume path_length "
              "max_5m_return min_5m_return max_abs_5m_return positive_5m_share rsv_positive rsv_negative "
              "semivariance_imbalance dollar_volume vwap close_vs_vwap_pct path_efficiency minute_coverage")
session_query("session_features_by_user", "session_open session_close rv_full_pct total_volume path_length "
              "path_efficiency first_hour_volume_share final_60_volume_share minute_coverage trend_slope_pct",
              by="user_id")
session_query("session_segments", "rv_full_pct rv_morning_pct rv_afternoon_pct rv_final_60_pct rv_final_30_pct "
              "first_hour_volume_share final_60_volume_share final_30_volume_share final_15_volume_share "
              "max_5m_volume_share return_final_15_pct return_final_30_pct return_final_60_pct "
              "return_1400_close_pct return_first_hour_pct")
session_query("session_trend", "trend_slope_pct")
session_query("session_extreme_times", "high_time_fraction low_time_fraction")


@query("session_bar_counts", with_(SESSIONS, """
SELECT symbol, pred_date, minute_bar_count, five_min_bar_count, incomplete_5m_buckets FROM sessions""", symbol="event_type"))
def session_bar_counts(spark, sf):
    five = intraday.five_minute_bars(tables.minute_bars(spark, sf))
    return intraday.session_features(five).select(
        "symbol", "pred_date", "minute_bar_count", "five_min_bar_count", "incomplete_5m_buckets")


@query("session_feature_join", with_(SESSIONS + """,
bars AS (
  SELECT symbol, CAST(ts AS DATE) AS pred_date, arg_max(price, row(ts, event_id)) AS close FROM ticks GROUP BY ALL)""", """
SELECT b.symbol, b.pred_date, b.close, s.session_close, round(s.rv_full_pct, 6) AS rv_full_pct,
       round((s.session_close / nullif(b.close, 0) - 1.0) * 100.0, 6) + 0.0 AS bench_gap_pct
FROM bars b LEFT JOIN sessions s ON b.symbol = s.symbol AND b.pred_date = s.pred_date""", symbol="user_id"))
def session_feature_join(spark, sf):
    """Daily bars of all-day ticks with their session features and the close-to-last-trade gap."""
    from ..operators.cross_section import benchmark_gap
    from ..plans.panel import attach_sessions

    daily = tables.event_daily_bars(spark, sf, "user_id").withColumnRenamed("date", "pred_date")
    sessions = intraday.session_features(intraday.five_minute_bars(tables.minute_bars(spark, sf, "user_id")))
    out = benchmark_gap(attach_sessions(daily, sessions)).select(
        "symbol", "pred_date", "close", "session_close", "rv_full_pct", "bench_gap_pct")
    return rounded(out, keep=("close", "session_close"))


@query("symbol_set_difference", with_(EVENT_BARS, """
SELECT DISTINCT symbol FROM ticks WHERE symbol NOT IN (SELECT symbol FROM five)""", symbol="user_id"))
def symbol_set_difference(spark, sf):
    """Symbols with ticks but no session bar."""
    from ..sources.bars import missing_symbols

    ticks = tables.event_ticks(spark, sf, "user_id")
    return missing_symbols(ticks, intraday.five_minute_bars(tables.minute_bars(spark, sf, "user_id")))


@query("symbols_without_morning", with_(EVENT_BARS, """
SELECT DISTINCT symbol FROM ticks WHERE symbol NOT IN (SELECT symbol FROM five WHERE bucket < 9)""", symbol="user_id"))
def symbols_without_morning(spark, sf):
    """Symbols with ticks but no bar in the first 45 minutes of a session."""
    from ..sources.bars import missing_symbols

    five = intraday.five_minute_bars(tables.minute_bars(spark, sf, "user_id")).where("bucket < 9")
    return missing_symbols(tables.event_ticks(spark, sf, "user_id"), five)
