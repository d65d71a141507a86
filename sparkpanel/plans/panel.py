"""Panel build: daily bars and session features in, the feature panel out.

Built in four blocks with a staged table between them: targets with session features,
symbol history, market table, cross-section.  Each block is narrow enough for
whole-stage code generation, and the panel is shuffled by symbol once and by
(session, value) once.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import count_nulls
from ..operators import calendar as cal, cross_section as cs, rolling
from ..operators.intraday import SESSION_COLUMNS
from ..sources.staging import stage


@dataclass(frozen=True)
class PanelBuild:
    panel: DataFrame
    calendar: DataFrame
    bounds: cal.SplitBounds


def attach_sessions(panel: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Left join of the session features; without intraday data they are all missing."""
    if sessions is None:
        return panel.select("*", *[F.lit(None).cast("double").alias(c) for c in SESSION_COLUMNS])
    return panel.join(sessions.select("symbol", "pred_date", *SESSION_COLUMNS), ["symbol", "pred_date"], "left")


def symbol_features(panel: DataFrame) -> DataFrame:
    """Everything that depends on one symbol's own rows."""
    df = cs.benchmark_gap(panel)
    df = cs.range_volatility(rolling.price_history(df))
    df = rolling.liquidity_history(rolling.overnight_history(df))
    df = rolling.sign_streak(df, "actual_return_pct", "on_sign_streak")
    df = df.select("*", *rolling.history_columns())
    df = cs.coverage_flag(cs.calendar_columns(cs.log_columns(df)))
    return rolling.trailing_ewm(df, "actual_magnitude_pct", "mag_ewm_20")


def feature_panel(panel: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """All features for a target panel (symbol, pred_date, prices, targets[, split])."""
    base = stage(attach_sessions(panel, sessions), "panel-base")
    hist = stage(symbol_features(base), "panel-history")
    market = stage(cs.market_lags(cs.market_by_session(hist)), "market")
    wide = stage(cs.relative_scores(hist).join(market, "pred_date", "left"), "panel-relative")
    wide = cs.stock_minus_market(wide)
    return wide.withColumn("n_missing_features", count_nulls(cs.feature_columns(wide)))


def build_panel(daily: DataFrame, sessions: DataFrame | None, train_end: str, valid_end: str,
                embargo: int = 5, mode: str = "research", min_history: int = 20) -> PanelBuild:
    """Scorable feature rows with split labels.

    Research mode cuts the test block off the daily scan before targets exist; the full
    calendar still names the next session of the last row before the cut.
    """
    cal.check_mode(mode)
    calendar = stage(cal.session_calendar(daily), "calendar")
    bounds = cal.split_bounds(calendar, train_end, valid_end, embargo)
    daily = cal.quarantine(daily, mode, bounds.test_start, "date")
    if sessions is not None:
        sessions = cal.quarantine(sessions, mode, bounds.test_start)
    targets = cal.label_splits(cal.overnight_targets(daily, calendar), bounds)
    features = cal.quarantine(feature_panel(targets, sessions), mode)
    return PanelBuild(cal.scorable_rows(features, min_history), calendar, bounds)
