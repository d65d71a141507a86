"""Model jobs on the daily panel; small ensembles keep the runs short, the rows are always all rows."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.confidence import MAGNITUDE_INPUTS
from ..operators import calendar as cal, cross_section as cs, glm, intraday, learners, linear, metrics as met, selection
from ..plans import confidence as conf, direction as dirn, final, magnitude as mag
from ..plans.panel import build_panel, feature_panel
from ..sources import tables
from ..sources.staging import stage
from .registry import query, rounded
from .sql import FACTS_PANEL, SCORED, SESSIONS, round_all, with_

TREE = dict(max_iter=5, depth=3, step=0.2, min_leaf=50)
FOREST = dict(trees=3, depth=4, min_leaf=50)
MCFG = mag.MagnitudeConfig(tree=TREE, forest=FOREST, min_train_rows=1000)
DCFG = dirn.DirectionConfig(tree=TREE, forest=FOREST)
#: The library's settings, without a cut; only the fewest rows of a fold's training block are those of these tables.
FULL_MCFG = mag.MagnitudeConfig(min_train_rows=MCFG.min_train_rows, parallel_fits=8)
FULL_DCFG = dirn.DirectionConfig(parallel_fits=8)
INPUTS = ["mag_lag_1", "mag_mean_5", "mag_mean_20", "mag_mean_60", "mag_ewm_20", "mag_std_20", "range_pct",
          "close_location", "mkt_ret_oc", "mkt_on_lag_1", "on_mean_20", "cs_rank_range_pct", "history_count"]


def model_panel(spark, sf):
    """Scorable rows of the daily panel; session_close is the average trade price.

    The baseline falls back to the mean of five moves, the last move and 0, so every scorable row stays.
    """
    built = build_panel(tables.daily_bars(spark, sf), None, tables.TRAIN_END, tables.VALID_END, mode="final-test")
    return stage(with_baseline(built.panel), "model-panel")


def with_baseline(panel):
    return panel.withColumn("mag_mean_20", F.coalesce("mag_mean_20", "mag_mean_5", "mag_lag_1", F.lit(0.0)))


def model_folds(panel, n: int = 5, reserve: int = 657):
    sessions = panel.where("split = 'train'").select(F.col("pred_date").alias("session")).distinct()
    return stage(cal.expanding_folds(sessions, n, reserve, 5), "folds")


def model_report(oof, groups):
    """Score, error and level of long forecasts."""
    return oof.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), met.magnitude_score("pred", mag.TARGET).alias("magnitude_score"),
        F.sqrt(F.avg((F.col("pred") - F.col(mag.TARGET)) ** 2)).alias("rmse"), F.avg("pred").alias("mean_pred"),
        F.min("pred").alias("min_pred"))


@query("feature_panel", with_(FACTS_PANEL, f"""
SELECT symbol, pred_date, split, history_count, {round_all('''ret_cc_pct ret_oc_pct gap_into_t_pct range_pct close_location
  parkinson garman_klass ret_2d_pct ret_5d_pct ret_20d_pct dist_20d_high_pct dist_20d_low_pct mag_lag_1 ret_lag_1
  mag_mean_5 mag_mean_20 mag_mean_60 mag_std_20 mag_median_20 mkt_ret_oc mkt_ret_cc mkt_breadth_up mkt_near_high
  mkt_on_lag_1 stock_minus_mkt_oc cs_rank_range_pct cs_z_range_pct cs_rank_close_location''')}
FROM final_panel"""))
def feature_panel_query(spark, sf):
    """The panel build end to end in research mode: scorable rows before the test block."""
    built = build_panel(tables.daily_bars(spark, sf), None, tables.TRAIN_END, tables.VALID_END)
    columns = """ret_cc_pct ret_oc_pct gap_into_t_pct range_pct close_location parkinson garman_klass ret_2d_pct
        ret_5d_pct ret_20d_pct dist_20d_high_pct dist_20d_low_pct mag_lag_1 ret_lag_1 mag_mean_5 mag_mean_20
        mag_mean_60 mag_std_20 mag_median_20 mkt_ret_oc mkt_ret_cc mkt_breadth_up mkt_near_high mkt_on_lag_1
        stock_minus_mkt_oc cs_rank_range_pct cs_z_range_pct cs_rank_close_location""".split()
    return rounded(built.panel.select(
        "symbol", "pred_date", "split", F.col("history_count").cast("bigint").alias("history_count"), *columns))


def _rank_sql(c: str) -> str:
    """Average rank over the number of present values of a session, rounded half up in whole numbers."""
    twice = (f"(2 * rank() OVER (PARTITION BY pred_date ORDER BY {c} ASC NULLS LAST)"
             f" + count(*) OVER (PARTITION BY pred_date, {c}) - 1)")
    return f"CASE WHEN {c} IS NOT NULL THEN ({twice} * 1000000 + count({c}) OVER d) // (2 * count({c}) OVER d) / 1e6 END"


@query("intraday_feature_panel", with_(SESSIONS + """,
bars AS (
  SELECT symbol, CAST(ts AS DATE) AS pred_date, arg_min(price, row(ts, event_id)) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, row(ts, event_id)) AS close FROM ticks GROUP BY ALL),
joined AS (
  SELECT b.*, s.* EXCLUDE (symbol, pred_date), (s.session_close / nullif(b.close, 0) - 1.0) * 100.0 AS bench_gap_pct,
    (b.close / nullif(b.open, 0) - 1.0) * 100.0 AS ret_oc_pct
  FROM bars b LEFT JOIN sessions s ON b.symbol = s.symbol AND b.pred_date = s.pred_date)""", f"""
SELECT symbol, pred_date, round(bench_gap_pct, 6) + 0.0 AS bench_gap_pct, round(rv_full_pct, 6) AS rv_full_pct,
  round(ln(1 + rv_full_pct), 6) AS log_rv_full_pct, round(ln(1 + dollar_volume), 6) AS log_dollar_volume,
  round(avg(rv_full_pct) OVER d, 6) AS mkt_rv, round(stddev_samp(rv_full_pct) OVER d, 6) AS mkt_rv_disp,
  round(avg(minute_coverage) OVER d, 6) AS mkt_coverage, round(avg(bench_gap_pct) OVER d, 6) + 0.0 AS mkt_bench_gap,
  round(rv_full_pct - avg(rv_full_pct) OVER d, 6) + 0.0 AS stock_minus_mkt_rv,
  round(rv_full_pct / nullif(avg(rv_full_pct) OVER d, 0), 6) AS rel_rv_ratio,
  {_rank_sql("rv_full_pct")} AS cs_rank_rv_full_pct, {_rank_sql("bench_gap_pct")} AS cs_rank_bench_gap_pct,
  round((close_vs_vwap_pct - avg(close_vs_vwap_pct) OVER d) / nullif(stddev_samp(close_vs_vwap_pct) OVER d, 0), 6) + 0.0
    AS cs_z_close_vs_vwap_pct
FROM joined WINDOW d AS (PARTITION BY pred_date)""", symbol="user_id"))
def intraday_feature_panel(spark, sf):
    """Daily and minute bars of the same symbols through the whole feature build."""
    daily = stage(tables.event_daily_bars(spark, sf, "user_id"), "event-daily")
    calendar = stage(cal.session_calendar(daily), "event-calendar")
    sessions = intraday.session_features(intraday.five_minute_bars(tables.minute_bars(spark, sf, "user_id")))
    panel = feature_panel(cal.overnight_targets(daily, calendar), sessions)
    return rounded(panel.select(
        "symbol", "pred_date", "bench_gap_pct", "rv_full_pct", "log_rv_full_pct", "log_dollar_volume", "mkt_rv",
        "mkt_rv_disp", "mkt_coverage", "mkt_bench_gap", "stock_minus_mkt_rv", "rel_rv_ratio", "cs_rank_rv_full_pct",
        "cs_rank_bench_gap_pct", "cs_z_close_vs_vwap_pct"))


def research_panel(spark, sf):
    """Scorable rows before the test block."""
    return build_panel(tables.daily_bars(spark, sf), None, tables.TRAIN_END, tables.VALID_END).panel


MARKET_COLUMNS = ["mkt_ret_oc", "mkt_ret_cc", "mkt_breadth_up", "mkt_near_high", "mkt_on_lag_1"]


@query("market_frame", with_(FACTS_PANEL, f"""
SELECT pred_date, round(avg(actual_return_pct), 6) AS mkt_target,
  {", ".join(f"round(max({c}), 6) AS {c}" for c in MARKET_COLUMNS)}
FROM final_panel GROUP BY pred_date"""))
def market_frame(spark, sf):
    """What the market leg is fitted on: one row per session."""
    return rounded(dirn.market_frame(research_panel(spark, sf), MARKET_COLUMNS))


@query("trailing_baseline", with_(FACTS_PANEL, """
SELECT split, count(*) AS n_rows, round(1 - sum(abs(pred - actual)) / sum(actual), 6) AS magnitude_score,
  round(sqrt(avg(pow(pred - actual, 2))), 6) AS rmse, round(avg(pred), 6) AS mean_pred, round(min(pred), 6) AS min_pred
FROM (SELECT split, actual_magnitude_pct AS actual, coalesce(mag_mean_20, mag_mean_5, mag_lag_1, 0) AS pred FROM final_panel)
GROUP BY split"""))
def trailing_baseline(spark, sf):
    """The candidate every other is held against, on all scorable rows of training and validation."""
    panel = with_baseline(research_panel(spark, sf))
    forecast = mag.fit_trailing(panel, [], MCFG)
    return rounded(model_report(forecast(panel, "pred"), ["split"]))


@query("feature_registry")
def feature_registry(spark, sf):
    """Model inputs with a mark for those that survive without the benchmark basis, and their coverage."""
    panel = model_panel(spark, sf)
    reduced = set(cs.feature_columns(panel, include_benchmark=False))
    names = cs.feature_columns(panel)
    seen = panel.agg(*[F.count(c).alias(c) for c in names])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in reduced).alias("without_benchmark"),
                                 F.col(c).alias("n_present")) for c in names])
    return seen.select(F.explode(entries).alias("e")).select("e.*")


RIDGE_ALPHA = 100.0


@query("ridge_two_features", with_(SCORED + f""",
fit_rows AS (
  SELECT coalesce(mag_mean_5, (SELECT quantile_cont(mag_mean_5, 0.5) FROM scored WHERE split = 'train')) AS x1,
    coalesce(mag_mean_20, (SELECT quantile_cont(mag_mean_20, 0.5) FROM scored WHERE split = 'train')) AS x2,
    ln(1 + actual_magnitude_pct) AS y FROM scored WHERE split = 'train'),
m AS (
  SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS r,
    covar_pop(x1, y) / stddev_pop(x1) AS b1, covar_pop(x2, y) / stddev_pop(x2) AS b2, avg(y) AS my FROM fit_rows),
solved AS (
  SELECT *, ((n + {RIDGE_ALPHA}) * n * b1 - n * r * n * b2) / (pow(n + {RIDGE_ALPHA}, 2) - pow(n * r, 2)) AS w1,
    ((n + {RIDGE_ALPHA}) * n * b2 - n * r * n * b1) / (pow(n + {RIDGE_ALPHA}, 2) - pow(n * r, 2)) AS w2 FROM m),
filled AS (
  SELECT pred_date, symbol,
    coalesce(mag_mean_5, (SELECT quantile_cont(mag_mean_5, 0.5) FROM scored WHERE split = 'train')) AS x1,
    coalesce(mag_mean_20, (SELECT quantile_cont(mag_mean_20, 0.5) FROM scored WHERE split = 'train')) AS x2
  FROM scored WHERE split = 'valid')""", """
SELECT pred_date, symbol, round(my + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2, 6) AS prediction FROM filled, solved"""))
def ridge_two_features(spark, sf):
    rows = tables.scored_frame(spark, sf)
    model = linear.fit_ridge(rows.where("split = 'train'"), ["mag_mean_5", "mag_mean_20"],
                             F.log1p("actual_magnitude_pct"), RIDGE_ALPHA)
    return rounded(rows.where("split = 'valid'").select("pred_date", "symbol", model.predict().alias("prediction")))


@query("market_ridge")
def market_ridge(spark, sf):
    """Market leg fitted on training sessions, its forecast for every later session."""
    panel = model_panel(spark, sf)
    model = dirn.fit_market(panel.where("split = 'train'"), DCFG)
    later = dirn.market_frame(panel.where("split <> 'train'"))
    return later.select("pred_date", "mkt_target", model.predict().alias("mu_market"), F.lit(model.alpha).alias("alpha"))


@query("oof_ridge")
def oof_ridge(spark, sf):
    panel = model_panel(spark, sf)
    registry = mag.candidates(MCFG)
    names = [mag.BASELINE, "M1_harx_ridge_smear", "M8_harx_full_ridge"]
    oof = mag.oof_forecasts(panel.where("split = 'train'"), model_folds(panel), {n: registry[n] for n in names},
                            cs.feature_columns(panel), MCFG)
    return model_report(oof, ["model"])


@query("oof_glm_family")
def oof_glm_family(spark, sf):
    """Gamma, Poisson and three Tweedie means over all folds."""
    panel = model_panel(spark, sf)
    registry = {n: f for n, f in mag.candidates(MCFG).items() if isinstance(f, mag.MeanCandidate)}
    oof = mag.oof_forecasts(panel.where("split = 'train'"), model_folds(panel), registry, INPUTS, MCFG)
    return model_report(oof, ["model"])


@query("glm_deviance")
def glm_deviance(spark, sf):
    """Penalised deviance of each round of the five fits on train; it never rises."""
    panel = model_panel(spark, sf)
    means = {n: f.mean for n, f in mag.candidates(MCFG).items() if isinstance(f, mag.MeanCandidate)}
    fits = glm.fit_means(panel.where("split = 'train'"), INPUTS, F.col(mag.TARGET), means)
    rows = [(n, m.fit.mean.power, m.penalty, i, float(d), bool(m.fit.converged)) for n, m in fits.items() for i, d in enumerate(m.fit.deviances)]
    return spark.createDataFrame(rows, "model string, power double, penalty double, round int, deviance double, converged boolean")


@query("oof_tree")
def oof_tree(spark, sf):
    panel = model_panel(spark, sf)
    registry = mag.candidates(MCFG)
    names = ["M4_trees_logl2_smear", "M6_trees_l2_direct", "S_quantile45_shadow"]
    oof = mag.oof_forecasts(panel.where("split = 'train'"), model_folds(panel, 2), {n: registry[n] for n in names},
                            INPUTS, MCFG)
    return model_report(oof, ["model"])


@query("magnitude_tournament")
def magnitude_tournament(spark, sf):
    """Candidates, non-negative blend and the raw / calibrated validation table with the selected row marked."""
    panel = model_panel(spark, sf)
    registry = {n: f for n, f in mag.candidates(MCFG).items() if n in (
        mag.BASELINE, "M1_harx_ridge_smear", "M7_poisson", "M6_trees_l2_direct")}
    result = mag.tournament(panel, model_folds(panel, 2), registry, INPUTS, MCFG)
    table = stage(result.table, "tournament")
    best = selection.select_magnitude(table).select("model", "variant", F.lit(True).alias("selected"))
    return table.join(best, ["model", "variant"], "left").na.fill(False, ["selected"])


@query("leaf_quantiles")
def leaf_quantiles(spark, sf):
    """Conditional quantiles of the return on validation rows with P(up)."""
    from ..functions.distribution import prob_up

    panel = model_panel(spark, sf)
    forest = dirn.fit_quantiles(panel.where("split = 'train'"), INPUTS, dirn.DirectionConfig())
    out = forest(panel.where("split = 'valid'").select("pred_date", "symbol", *INPUTS), "q")
    return out.select("pred_date", "symbol", "q", prob_up("q", list(DCFG.levels)).alias("p_up"))


def confidence_rows(spark, sf):
    """Confidence inputs with the market and momentum stand-ins of the two legs."""
    from ..functions.columns import hash_fraction
    from ..functions.confidence import confidence_inputs

    market, residual = F.col("pred_direction") * 0.5, tables.short_minus_long() / 50.0
    rows = tables.scored_frame(spark, sf)
    return stage(confidence_inputs(rows.select(
        "split", "pred_date", "symbol", "actual_return_pct", "pred_magnitude_pct", market.alias("mu_market"),
        residual.alias("mu_residual"), (market + residual).alias("mu_total"),
        hash_fraction(5, "symbol", "pred_date").alias("p_up"))), "confidence-rows")


@query("logistic_confidence")
def logistic_confidence(spark, sf):
    """All seven direction-confidence candidates side by side."""
    rows = confidence_rows(spark, sf)
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in conf.DIRECTION_INPUTS if c not in rows.columns})
    return conf.direction_candidates(rows.where("split = 'train'"), rows.where("split = 'valid'"))[0]


@query("label_calibration")
def label_calibration(spark, sf):
    """Platt calibration of the quality label on the document length, fitted on four fifths of the documents by a hash of their id
    and reported on the rest."""
    docs = tables.table(spark, sf, "documents").select("doc_id", F.log1p("n_chars").alias("length"))
    rows = tables.table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "length", F.col("quality").cast("double").alias("quality"))
    rows = stage(rows.withColumn("rest", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0), "labels")
    scored = learners.fit_logistic(rows.where("not rest"), ["length"], "quality")(rows.where("rest"), "q")
    return met.calibration_report(scored, [], "q", "quality")


@query("two_stage_reliability")
def two_stage_reliability(spark, sf):
    """All magnitude-confidence candidates on validation: rank report per candidate.

    The forecast is the trailing mean of every scorable row.  The models have all their inputs and the library's own settings; the
    quantile widths come from forests that did not see the row, and are missing before the first fold.
    """
    from ..operators import calibration as calib, rolling

    panel = model_panel(spark, sf)
    # the driver plans 127 inputs for each forest: two at a time
    widths = dirn.quantile_features(panel, model_folds(panel), cs.feature_columns(panel), replace(FULL_DCFG, parallel_fits=2))
    rows = panel.join(widths, mag.KEYS, "left").withColumn("pred_magnitude_pct", F.col("mag_mean_20"))
    rows = stage(rows.select(*mag.KEYS, "split", mag.TARGET, *[c for c in MAGNITUDE_INPUTS if c in rows.columns],
                             F.abs(F.col("pred_magnitude_pct") - F.col(mag.TARGET)).alias("oof_abs_error")), "reliability-rows")
    train = stage(rolling.error_history(rows.where("split = 'train'")), "reliability-train")
    valid = stage(calib.attach_error_history(rows.where("split = 'valid'"), train), "reliability-valid")
    out = conf.magnitude_confidences(train, valid)
    return conf.magnitude_candidates(stage(out, "confidences"))


@query("benchmark_ablation")
def benchmark_ablation(spark, sf):
    """Diagnostics with and without the basis columns; session_close is the average trade price."""
    daily = tables.daily_bars(spark, sf)
    traded = tables.trade_ticks(spark, sf).groupBy("symbol", F.col("date").alias("pred_date")).agg(
        F.when(F.count(F.lit(1)) > 1, F.sum("l_extendedprice") / F.sum("l_quantity")).alias("session_close"))
    blank = [F.lit(None).cast("double").alias(c) for c in intraday.SESSION_COLUMNS if c != "session_close"]
    built = build_panel(daily, traded.select("*", *blank), tables.TRAIN_END, tables.VALID_END)
    panel = stage(with_baseline(built.panel), "ablation-input")
    return dirn.benchmark_ablation(panel, [*INPUTS, "bench_gap_pct", "bench_gap_abs"], 0.5, DCFG)


@query("final_scoring")
def final_scoring(spark, sf):
    """Research stages, selections and the final scoring of all splits: one row of metrics per split and scope.

    The whole job: five folds, every candidate, every input of the panel and the library's own settings of the learners.
    """
    panel = model_panel(spark, sf)
    folds, inputs, registry = model_folds(panel), cs.feature_columns(panel), mag.candidates(FULL_MCFG)
    contest = mag.tournament(panel, folds, registry, inputs, FULL_MCFG)
    best = selection.select_magnitude(stage(contest.table, "contest")).first()
    direction = dirn.research(panel, folds, inputs, FULL_DCFG)
    chosen = lambda t: t.where(F.col("model") == best.model).select(
        "pred_date", "symbol", F.col("pred").alias("pred_magnitude_pct"))
    research = conf.research(direction.oof, direction.valid, panel, chosen(contest.oof), chosen(contest.valid))
    choice = final.Selection(best.model, best.variant, contest.weights, direction.shrinkage,
                             research.direction_choice, research.magnitude_choice)
    scored = final.score_all(panel, contest, direction, choice, inputs, registry, FULL_MCFG, FULL_DCFG)
    return met.statistics_table(scored)
