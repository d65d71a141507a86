"""Calibration, distribution and confidence expressions on forecasts derived from the daily panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hash_fraction
from ..functions.confidence import confidence_inputs, flip_rule
from ..functions.distribution import LEVELS, crossings, distribution_features, prob_up, rearranged
from ..operators import calibration as calib, metrics as met, rolling, selection
from ..sources import tables
from ..sources.staging import stage
from .registry import query, rounded
from .sql import HISTORY, SCORED, SPLITS, fraction, round_all, with_

MODELS = ["mag_mean_5", "mag_mean_20", "mag_mean_60", "mag_median_20"]
FORECASTS = SCORED + """,
forecasts AS (
  SELECT * REPLACE (coalesce(mag_mean_5, pred_magnitude_pct) AS mag_mean_5, coalesce(mag_mean_20, pred_magnitude_pct) AS mag_mean_20,
    coalesce(mag_mean_60, pred_magnitude_pct) AS mag_mean_60, coalesce(mag_median_20, pred_magnitude_pct) AS mag_median_20)
  FROM scored),
long AS (
  SELECT split, pred_date, symbol, actual_magnitude_pct, mag_mean_20,
    unnest(['mag_mean_5', 'mag_mean_20', 'mag_mean_60', 'mag_median_20']) AS model,
    unnest([mag_mean_5, mag_mean_20, mag_mean_60, mag_median_20]) AS pred FROM forecasts)"""


def forecasts(spark, sf):
    """All scored rows; a model without a forecast takes the baseline's."""
    return tables.scored_frame(spark, sf).withColumns({m: F.coalesce(m, "pred_magnitude_pct") for m in MODELS})


def long_forecasts(spark, sf):
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in MODELS]))
    return forecasts(spark, sf).select("split", "pred_date", "symbol", "actual_magnitude_pct", "mag_mean_20",
                                       entries.alias("e")).select("*", "e.model", "e.pred").drop("e")


LINES = FORECASTS + """,
lines AS (
  SELECT model, regr_intercept(actual_magnitude_pct, pred) AS calib_a0,
    greatest(regr_slope(actual_magnitude_pct, pred), 0) AS calib_b FROM long WHERE split = 'train' GROUP BY model)"""


@query("affine_calibration", with_(LINES, f"SELECT model, {round_all('calib_a0 calib_b')} FROM lines"))
def affine_calibration(spark, sf):
    train = long_forecasts(spark, sf).where("split = 'train'")
    return rounded(calib.affine_calibration(train, ["model"], "pred", "actual_magnitude_pct"))


@query("calibrated_forecasts", with_(LINES, """
SELECT pred_date, symbol, model, round(greatest(calib_a0 + calib_b * pred, 0), 6) AS calibrated
FROM long JOIN lines USING (model) WHERE split = 'valid'"""))
def calibrated_forecasts(spark, sf):
    long = stage(long_forecasts(spark, sf), "long-forecasts")
    lines = stage(calib.affine_calibration(
        long.where("split = 'train'"), ["model"], "pred", "actual_magnitude_pct"), "lines")
    return rounded(long.where("split = 'valid'").join(lines, "model").select(
        "pred_date", "symbol", "model",
        calib.apply_affine("pred", F.col("calib_a0"), F.col("calib_b")).alias("calibrated")))


@query("semantic_gate", with_(FORECASTS, """
SELECT model, round(avg(pred), 6) AS mean_pred, round(avg(actual_magnitude_pct), 6) AS mean_actual,
  round(100.0 * (avg(pred) / avg(actual_magnitude_pct) - 1.0), 6) AS mean_gap_pct,
  round(regr_slope(actual_magnitude_pct, pred), 6) AS calib_slope,
  round(regr_intercept(actual_magnitude_pct, pred), 6) AS calib_intercept,
  abs(100.0 * (avg(pred) / avg(actual_magnitude_pct) - 1.0)) <= 5.0 AS passes_mean_gate,
  regr_slope(actual_magnitude_pct, pred) BETWEEN 0.7 AND 1.4 AS passes_slope_gate
FROM long WHERE split = 'valid' GROUP BY model"""))
def semantic_gate(spark, sf):
    rows = long_forecasts(spark, sf).where("split = 'valid'")
    return rounded(met.semantic_gate(rows, ["model"], "pred", "actual_magnitude_pct"))


CANDIDATES = LINES + """,
variants AS (
  SELECT model, 'raw' AS variant, pred_date, symbol, actual_magnitude_pct AS a, mag_mean_20 AS v, pred AS p
  FROM long WHERE split = 'valid'
  UNION ALL
  SELECT model, 'calibrated', pred_date, symbol, actual_magnitude_pct, mag_mean_20, greatest(calib_a0 + calib_b * pred, 0)
  FROM long JOIN lines USING (model) WHERE split = 'valid'),
ranked AS (
  SELECT model, variant, pred_date,
    rank() OVER (PARTITION BY model, variant, pred_date ORDER BY p)
      + (count(*) OVER (PARTITION BY model, variant, pred_date, p) - 1) / 2.0 AS rp,
    rank() OVER (PARTITION BY model, variant, pred_date ORDER BY a)
      + (count(*) OVER (PARTITION BY model, variant, pred_date, a) - 1) / 2.0 AS ra FROM variants),
ics AS (
  SELECT model, variant, avg(ic) AS rank_ic FROM (
    SELECT model, variant, pred_date, CASE WHEN min(rp) < max(rp) AND min(ra) < max(ra) THEN corr(rp, ra) END AS ic
    FROM ranked GROUP BY ALL HAVING count(*) > 5) GROUP BY ALL),
table0 AS (
  SELECT model, variant, 1 - sum(abs(p - a)) / sum(a) AS magnitude_score, avg(abs(p - a)) AS mae,
    sqrt(avg(pow(p - a, 2))) AS rmse, 1 - sum(pow(p - a, 2)) / nullif(sum(pow(v - a, 2)), 0) AS r2_vs_vol,
    100.0 * (avg(p) / avg(a) - 1.0) AS mean_gap_pct, regr_slope(a, p) AS calib_slope,
    abs(100.0 * (avg(p) / avg(a) - 1.0)) <= 5.0 AS passes_mean_gate,
    coalesce(regr_slope(a, p) BETWEEN 0.7 AND 1.4, false) AS passes_slope_gate FROM variants GROUP BY ALL)"""


def candidates(spark, sf):
    from ..plans.magnitude import validation_table

    long = stage(long_forecasts(spark, sf), "long-forecasts")
    table = validation_table(long.where("split = 'train'").drop("split"), long.where("split = 'valid'").drop("split"))
    return table.withColumn("passes_slope_gate", F.coalesce("passes_slope_gate", F.lit(False)))


COLUMNS = "magnitude_score mae rmse rank_ic r2_vs_vol mean_gap_pct calib_slope"


@query("magnitude_candidates", with_(CANDIDATES, f"""
SELECT model, variant, {round_all(COLUMNS)}, passes_mean_gate, passes_slope_gate
FROM table0 JOIN ics USING (model, variant)"""))
def magnitude_candidates(spark, sf):
    return rounded(candidates(spark, sf).select(
        "model", "variant", *COLUMNS.split(), "passes_mean_gate", "passes_slope_gate"))


@query("select_magnitude", with_(CANDIDATES, """
SELECT model, variant, round(magnitude_score, 6) AS magnitude_score FROM table0
ORDER BY (passes_mean_gate AND passes_slope_gate) DESC,
  CASE WHEN passes_mean_gate AND passes_slope_gate THEN -magnitude_score ELSE abs(mean_gap_pct) END, rmse, model, variant
LIMIT 1"""))
def select_magnitude(spark, sf):
    table = stage(candidates(spark, sf), "candidates")
    return rounded(selection.select_magnitude(table).select("model", "variant", "magnitude_score"))


@query("blend_gram", with_(FORECASTS, "\nUNION ALL\n".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(sum({a} * {b}), 2) AS value FROM forecasts WHERE split = 'train'"
    for i, a in enumerate(MODELS) for b in [*MODELS[i:], "actual_magnitude_pct"])))
def blend_gram(spark, sf):
    train = forecasts(spark, sf).where("split = 'train'")
    return rounded(calib.gram_table(train, MODELS, "actual_magnitude_pct"), 2)


def _descent_sql(k: int, rounds: int) -> str:
    """Non-negative weights by coordinate descent on the cross products g{i}{j} and t{i} of the CTE ``gram``."""
    turn = [f"CASE WHEN n % {k} = {i} THEN greatest((t{i} - ({' + '.join(f'g{min(i, j)}{max(i, j)} * w{j}' for j in range(k) if j != i)})) / g{i}{i}, 0) ELSE w{i} END"
            for i in range(k)]
    zeros = ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(k))
    return (f"descent AS (SELECT 0 AS n, {zeros} UNION ALL SELECT n + 1, {', '.join(turn)} FROM descent, gram WHERE n < {rounds})")


_GRAM = ", ".join([f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(MODELS) for j, b in enumerate(MODELS) if j >= i]
                  + [f"sum({a} * actual_magnitude_pct) AS t{i}" for i, a in enumerate(MODELS)])
_COMPLETE = " AND ".join(f"{m} IS NOT NULL" for m in [*MODELS, "actual_magnitude_pct"])


@query("blend_weights", with_(FORECASTS + f""",
gram AS (SELECT {_GRAM} FROM forecasts WHERE split = 'train' AND {_COMPLETE}),
""" + _descent_sql(len(MODELS), 4_000) + f""",
w AS (SELECT {", ".join(f"round_even(w{i} / ({' + '.join(f'w{j}' for j in range(len(MODELS)))}), 4) AS w{i}" for i in range(len(MODELS)))}
  FROM descent WHERE n = 4000)""", f"""
SELECT {", ".join(f"any_value(w{i}) AS weight_{m}" for i, m in enumerate(MODELS))},
  round(1 - sum(abs({" + ".join(f"w{i} * {m}" for i, m in enumerate(MODELS))} - actual_magnitude_pct)) / sum(actual_magnitude_pct), 6) AS blend_score,
  round(1 - sum(abs(mag_mean_20 - actual_magnitude_pct)) / sum(actual_magnitude_pct), 6) AS baseline_score
FROM forecasts, w WHERE split = 'valid'""").replace("WITH ", "WITH RECURSIVE ", 1))
def blend_weights(spark, sf):
    """Non-negative weights of the four forecasts and the error of the blend on validation."""
    rows = stage(forecasts(spark, sf), "forecasts")
    weights = calib.blend_weights(rows.where("split = 'train'"), MODELS, "actual_magnitude_pct")
    valid = rows.where("split = 'valid'").withColumn("blend", calib.blended(weights))
    return rounded(valid.agg(
        *[F.lit(w).alias(f"weight_{m}") for m, w in weights.items()],
        met.magnitude_score("blend", "actual_magnitude_pct").alias("blend_score"),
        met.magnitude_score("mag_mean_20", "actual_magnitude_pct").alias("baseline_score")))


@query("smearing", with_(FORECASTS + """,
logs AS (SELECT ln(1 + actual_magnitude_pct) AS y, ln(1 + mag_mean_20) AS z, split FROM forecasts)""", """
SELECT round(s, 6) AS smear, round(avg(greatest(exp(z) * s - 1, 0)), 6) AS mean_pred
FROM logs, (SELECT avg(exp(y - z)) AS s FROM logs WHERE split = 'train') WHERE split = 'valid' GROUP BY s"""))
def smearing(spark, sf):
    logs = stage(forecasts(spark, sf).select(
        "split", F.log1p("actual_magnitude_pct").alias("y"), F.log1p("mag_mean_20").alias("z")), "logs")
    s = stage(logs.where("split = 'train'").agg(calib.smearing_factor("y", "z").alias("s")), "smear")
    return rounded(logs.where("split = 'valid'").crossJoin(s).groupBy("s").agg(
        F.avg(calib.from_log1p("z", F.col("s"))).alias("mean_pred")).select(F.col("s").alias("smear"), "mean_pred"))


# ---- quantile arrays from two trailing windows, so that neighbours may cross; rounded, as
# the engines interpolate differently in the last bit and a tie would count as a crossing
def quantile_rows(spark, sf):
    panel = tables.history_panel(spark, sf).select("symbol", "pred_date", "actual_return_pct", "history_count")
    short, long = rolling.prior(20), rolling.prior(60)
    picks = [F.round(F.percentile("actual_return_pct", t).over(short if i % 2 else long), 6) for i, t in enumerate(LEVELS)]
    rows = panel.select("symbol", "pred_date", "actual_return_pct", F.array(*picks).alias("raw"),
                        F.count("actual_return_pct").over(short).alias("seen"))
    rows = stage(rows.where("seen >= 5"), "quantile-rows")
    return rows.withColumn("q", rearranged("raw"))


QUANTILES = SPLITS + """,
quantile_rows AS (
  SELECT *, list_sort(raw) AS q FROM (
    SELECT symbol, pred_date, actual_return_pct, count(actual_return_pct) OVER s AS seen,
      [""" + ", ".join(f"round(quantile_cont(actual_return_pct, {t}) OVER {'s' if i % 2 else 'l'}, 6)"
                       for i, t in enumerate(LEVELS)) + """] AS raw
    FROM panel
    WINDOW s AS (PARTITION BY symbol ORDER BY pred_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
      l AS (PARTITION BY symbol ORDER BY pred_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
  WHERE seen >= 5)"""


@query("quantile_rearrange", with_(QUANTILES, """
SELECT symbol, pred_date, CAST(len(list_filter(range(1, 11), lambda i: raw[i + 1] < raw[i])) AS INTEGER) AS crossings,
  q FROM quantile_rows"""))
def quantile_rearrange(spark, sf):
    return quantile_rows(spark, sf).select(
        "symbol", "pred_date", crossings("raw").alias("crossings"), "q")


PROB = """CASE WHEN q[1] > 0 THEN 1 - 1e-6 WHEN q[11] <= 0 THEN 1e-6 ELSE
  least(greatest(1 - (tau[j] + coalesce((0 - q[j]) / nullif(q[j + 1] - q[j], 0), 0) * (tau[j + 1] - tau[j])), 1e-6), 1 - 1e-6)
  END"""
PROBS = QUANTILES + f""",
probs AS (
  SELECT *, {PROB} AS p_up FROM (
    SELECT *, least(greatest(len(list_filter(q, lambda x: x <= 0)), 1), 10) AS j, {LEVELS}::DOUBLE[] AS tau
    FROM quantile_rows))"""


@query("prob_up", with_(PROBS, "SELECT symbol, pred_date, round(p_up, 6) AS p_up FROM probs"))
def prob_up_query(spark, sf):
    return rounded(quantile_rows(spark, sf).select("symbol", "pred_date", prob_up("q").alias("p_up")))


@query("distribution_features", with_(QUANTILES, """
SELECT symbol, pred_date, round(q[6], 6) AS q_median, round(q[10] - q[2], 6) AS q_iqr80, round(q[11] - q[1], 6) AS q_iqr90,
  round((q[10] + q[2] - 2 * q[6]) / greatest(q[10] - q[2], 1e-9), 6) AS q_skew, round(abs(q[1]), 6) AS q_left_tail,
  round(abs(q[11]), 6) AS q_right_tail, round(abs(q[6]), 6) AS q_median_abs FROM quantile_rows"""))
def distribution_feature_query(spark, sf):
    return rounded(quantile_rows(spark, sf).select(
        "symbol", "pred_date", *[v.alias(k) for k, v in distribution_features("q").items()]))


# ---- direction confidence ---------------------------------------------------------------
INPUTS = SCORED + f""",
inputs AS (
  SELECT *, CASE WHEN mu_total >= 0 THEN 1.0 ELSE -1.0 END AS base_direction FROM (
    SELECT *, pred_direction * 0.5 AS mu_market, coalesce(mag_mean_5 - mag_mean_20, 0) / 50.0 AS mu_residual,
      pred_direction * 0.5 + coalesce(mag_mean_5 - mag_mean_20, 0) / 50.0 AS mu_total, {fraction(5, 'symbol', 'pred_date')} AS p_up
    FROM scored))"""


def direction_rows(spark, sf):
    market, residual = F.col("pred_direction") * 0.5, tables.short_minus_long() / 50.0
    rows = tables.scored_frame(spark, sf).select(
        "split", "pred_date", "symbol", "actual_return_pct", "pred_magnitude_pct", market.alias("mu_market"),
        residual.alias("mu_residual"), (market + residual).alias("mu_total"),
        hash_fraction(5, "symbol", "pred_date").alias("p_up"))
    return confidence_inputs(rows)


@query("confidence_inputs", with_(INPUTS, """
SELECT pred_date, symbol, base_direction::DOUBLE AS base_direction,
  round(CASE WHEN base_direction > 0 THEN p_up ELSE 1 - p_up END, 6) AS p_up_emitted, round(abs(mu_total), 6) AS abs_mu,
  round(abs(mu_total) / greatest(pred_magnitude_pct, 1e-6), 6) AS mu_over_mag,
  (sign(mu_market) = sign(mu_residual))::INT::DOUBLE AS market_residual_agree,
  (sign(mu_market) <> sign(mu_total))::INT::DOUBLE AS residual_flips_market,
  (base_direction = CASE WHEN actual_return_pct >= 0 THEN 1 ELSE -1 END)::INT::DOUBLE AS correct FROM inputs"""))
def confidence_inputs_query(spark, sf):
    return rounded(direction_rows(spark, sf).select(
        "pred_date", "symbol", "base_direction", "p_up_emitted", "abs_mu", "mu_over_mag", "market_residual_agree",
        "residual_flips_market", "correct"))


@query("flip_rule", with_(INPUTS, """
SELECT pred_date, symbol, (CASE WHEN p_up < 0.5 THEN -base_direction ELSE base_direction END)::DOUBLE AS direction,
  round(CASE WHEN p_up < 0.5 THEN 1 - p_up ELSE p_up END, 6) AS confidence FROM inputs"""))
def flip_rule_query(spark, sf):
    d, conf = flip_rule("base_direction", "p_up")
    return rounded(direction_rows(spark, sf).select("pred_date", "symbol", d.alias("direction"), conf.alias("confidence")))


def direction_table_sql(entries: str) -> str:
    """Candidate table of ``entries`` (model, base_direction, a, q): calibration of the emitted confidence, lift, flips."""
    return entries + """,
emitted AS (
  SELECT *, (d = CASE WHEN a >= 0 THEN 1 ELSE -1 END)::INT::DOUBLE AS correct,
    """ + " + ".join(f"(conf >= {e})::INT" for e in met.ECE_EDGES) + """ AS bin
  FROM (SELECT *, CASE WHEN q < 0.5 THEN -base_direction ELSE base_direction END AS d,
          CASE WHEN q < 0.5 THEN 1 - q ELSE q END AS conf FROM entries)),
gaps AS (SELECT model, sum(gap) AS gap FROM (
  SELECT model, bin, abs(sum(correct - conf)) AS gap FROM emitted GROUP BY ALL) GROUP BY model),
table0 AS (
  SELECT model, avg(pow(conf - correct, 2)) AS brier, 1 - avg(pow(conf - correct, 2)) / var_pop(correct) AS brier_skill,
    -avg(correct * ln(least(greatest(conf, 1e-6), 1 - 1e-6))
         + (1 - correct) * ln(1 - least(greatest(conf, 1e-6), 1 - 1e-6))) AS log_loss,
    any_value(gap) / count(*) AS ece_10, avg(conf) AS mean_conf, avg(correct) AS acc,
    CASE WHEN abs(sum((2 * conf - 1) * d * a) / sum((2 * conf - 1) * abs(a)) - sum(d * a) / sum(abs(a))) < 1e-12 THEN 0.0
      ELSE sum((2 * conf - 1) * d * a) / sum((2 * conf - 1) * abs(a)) - sum(d * a) / sum(abs(a)) END AS lift,
    count(*) FILTER (q < 0.5) AS flips, sum(d * a) / sum(abs(a)) AS pooled_ds
  FROM emitted JOIN gaps USING (model) GROUP BY model)"""


DIRECTION_CANDIDATES = direction_table_sql(INPUTS + """,
rates AS (SELECT avg((base_direction = CASE WHEN actual_return_pct >= 0 THEN 1 ELSE -1 END)::INT) AS rate
          FROM inputs WHERE split = 'train'),
entries AS (
  SELECT 'C0_constant' AS model, base_direction, actual_return_pct AS a, rate AS q FROM inputs, rates WHERE split = 'valid'
  UNION ALL
  SELECT 'C1_raw_quantile_prob', base_direction, actual_return_pct,
    least(greatest(CASE WHEN base_direction > 0 THEN p_up ELSE 1 - p_up END, 1e-6), 1 - 1e-6)
  FROM inputs WHERE split = 'valid')""")
REPORT = "brier brier_skill log_loss ece_10 mean_conf acc lift pooled_ds"


def direction_candidate_rows(spark, sf):
    from ..plans.confidence import direction_candidates

    rows = stage(direction_rows(spark, sf), "direction-rows")
    table = direction_candidates(rows.where("split = 'train'"), rows.where("split = 'valid'"),
                                 ["C0_constant", "C1_raw_quantile_prob"])[0]
    # the lift of a constant confidence is zero up to the last bit, whose sign depends on the engine
    return table.withColumn("lift", F.when(F.abs("lift") < 1e-12, 0.0).otherwise(F.col("lift")))


@query("direction_confidence_candidates", with_(
    DIRECTION_CANDIDATES, f"SELECT model, {round_all(REPORT)}, flips FROM table0"))
def direction_confidence_candidates(spark, sf):
    return rounded(direction_candidate_rows(spark, sf))


@query("select_direction_confidence", with_(DIRECTION_CANDIDATES, """
SELECT model, round(brier, 6) AS brier FROM table0
ORDER BY coalesce(brier_skill >= 0 AND lift > 0 AND model <> 'C0_constant', false) DESC, brier, log_loss, ece_10, model
LIMIT 1"""))
def select_direction_confidence(spark, sf):
    table = stage(direction_candidate_rows(spark, sf), "table")
    return rounded(selection.select_direction_confidence(table).select("model", "brier"))


@query("select_shrinkage", with_(SCORED, """
SELECT "lambda", round(sum(d * actual_return_pct) / sum(abs(actual_return_pct)), 6) AS pooled_ds
FROM (SELECT *, CASE WHEN pred_direction + "lambda" * coalesce(mag_mean_5 - mag_mean_20, 0) / 100.0 >= 0 THEN 1 ELSE -1 END AS d
      FROM scored, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.25]::DOUBLE[]) AS "lambda"))
GROUP BY "lambda" ORDER BY sum(d * actual_return_pct) / sum(abs(actual_return_pct)) DESC, "lambda" LIMIT 1"""))
def select_shrinkage(spark, sf):
    from .scoring import lambda_grid

    return selection.select_shrinkage(lambda_grid(spark, sf)).select("lambda", "pooled_ds")


# ---- magnitude confidence -----------------------------------------------------------------
@query("ecdf_confidence", with_(SCORED, """
SELECT pred_date, symbol, round(1 - below / total, 6) AS confidence FROM (
  SELECT pred_date, symbol, split, pred_magnitude_pct AS risk,
    count(*) FILTER (split = 'train') OVER (ORDER BY pred_magnitude_pct RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - count(*) FILTER (split = 'train') OVER (PARTITION BY pred_magnitude_pct) AS below,
    count(*) FILTER (split = 'train') OVER () AS total FROM scored) WHERE split <> 'train'"""))
def ecdf_confidence(spark, sf):
    rows = tables.scored_frame(spark, sf).select("pred_date", "symbol", "split", "pred_magnitude_pct")
    scored = calib.ecdf_confidence(rows.where("split <> 'train'"), rows.where("split = 'train'"),
                                   "pred_magnitude_pct", ["pred_date", "symbol"])
    return rounded(scored.select("pred_date", "symbol", "confidence"))


@query("inverse_rank_confidence", with_(SCORED, """
SELECT pred_date, symbol, round((row_number() OVER (ORDER BY -pred_magnitude_pct, pred_date, symbol) - 1)
  / count(*) OVER ()::DOUBLE, 6) AS confidence FROM scored WHERE split = 'test'"""))
def inverse_rank_confidence(spark, sf):
    rows = tables.scored_frame(spark, sf).where("split = 'test'").select("pred_date", "symbol", "pred_magnitude_pct")
    return rounded(calib.inverse_rank_confidence(rows, "pred_magnitude_pct", ["pred_date", "symbol"]).select(
        "pred_date", "symbol", "confidence"))


@query("error_history_attach", with_(HISTORY + """,
errors AS (
  SELECT *, abs(mag_mean_20 - actual_magnitude_pct) AS err FROM hist
  WHERE split = 'train' AND mag_mean_20 IS NOT NULL AND actual_magnitude_pct IS NOT NULL),
errs AS (
  SELECT symbol, pred_date, CASE WHEN count(err) OVER w >= 5 THEN avg(err) OVER w END AS m,
    CASE WHEN count(err) OVER w >= 5 THEN stddev_samp(err) OVER w END AS s FROM errors
  WINDOW w AS (PARTITION BY symbol ORDER BY pred_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
lasts AS (
  SELECT symbol, arg_max(m, pred_date) FILTER (m IS NOT NULL) AS lm, arg_max(s, pred_date) FILTER (s IS NOT NULL) AS ls
  FROM errs GROUP BY symbol)""", """
SELECT h.symbol, h.pred_date, round(CASE WHEN split = 'train' THEN m ELSE lm END, 6) AS err_hist_mean_20,
  round(CASE WHEN split = 'train' THEN s ELSE ls END, 6) AS err_hist_std_20
FROM hist h LEFT JOIN errs e ON h.symbol = e.symbol AND h.pred_date = e.pred_date LEFT JOIN lasts l ON h.symbol = l.symbol"""))
def error_history_attach(spark, sf):
    panel = stage(tables.history_panel(spark, sf).select(
        "symbol", "pred_date", "split", "mag_mean_20", "actual_magnitude_pct"), "history")
    errors = panel.where("split = 'train'").withColumn(
        "oof_abs_error", F.abs(F.col("mag_mean_20") - F.col("actual_magnitude_pct"))).where("oof_abs_error is not null")
    history = stage(rolling.error_history(errors), "error-history")
    return rounded(calib.attach_error_history(panel, history).select(
        "symbol", "pred_date", "err_hist_mean_20", "err_hist_std_20"))
