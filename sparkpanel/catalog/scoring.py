"""Scoring metrics on the scored frame."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as met, selection
from ..sources import tables
from ..sources.staging import stage
from .registry import query, rounded
from .sql import SCORED, TARGETS, fraction, round_all, with_

# ---- SQL of the scored rows, once per scope -------------------------------------------
SCOPED = SCORED + """,
scoped AS (
  SELECT *, abs(a) AS abs_a, abs(pred_magnitude_pct - abs(a)) AS err, 2 * conf_direction - 1 AS w,
    CASE WHEN (CASE WHEN a >= 0 THEN 1 ELSE -1 END) = pred_direction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct
  FROM (SELECT *, 'pooled' AS scope, actual_return_pct AS a FROM scored
        UNION ALL SELECT *, 'residual', actual_return_pct - universe_mean_pct FROM scored)),
binned AS (
  SELECT split, scope, bin, abs(sum(correct - conf_direction)) AS gap FROM (
    SELECT *, """ + " + ".join(f"(conf_direction >= {e})::INT" for e in met.ECE_EDGES) + """ AS bin FROM scoped)
  GROUP BY ALL),
sums AS (
  SELECT split, scope, count(*) AS n, sum(pred_direction * a) / sum(abs_a) AS direction_score,
    avg(pred_direction * a) AS directional_return_pct, 1 - sum(err) / sum(abs_a) AS magnitude_score,
    sum(w * pred_direction * a) / sum(w * abs_a) AS conf_direction_score,
    sum(w * pred_direction * a) / sum(w * abs_a) - sum(pred_direction * a) / sum(abs_a) AS conf_direction_lift,
    avg(correct) AS hit_rate, avg((a >= 0)::INT) FILTER (pred_direction = 1) AS precision_up,
    avg((pred_direction = 1)::INT) FILTER (a >= 0) AS recall_up,
    count(*) FILTER (pred_direction = 1) AS n_up, count(*) FILTER (a >= 0) AS n_actual_up,
    avg(pow(conf_direction - correct, 2)) AS brier,
    1 - avg(pow(conf_direction - correct, 2)) / var_pop(correct) AS brier_skill,
    -avg(correct * ln(least(greatest(conf_direction, 1e-6), 1 - 1e-6))
         + (1 - correct) * ln(1 - least(greatest(conf_direction, 1e-6), 1 - 1e-6))) AS log_loss,
    avg(err) AS mae, sqrt(avg(pow(pred_magnitude_pct - abs_a, 2))) AS rmse,
    1 - sum(pow(pred_magnitude_pct - abs_a, 2)) FILTER (vol_baseline_20 IS NOT NULL)
        / sum(pow(vol_baseline_20 - abs_a, 2)) AS r2_vs_vol, count(vol_baseline_20) AS n_vol,
    1 - var_pop(actual_return_pct - universe_mean_pct) / var_pop(actual_return_pct) AS var_share_universe
  FROM scoped GROUP BY split, scope),
ece AS (
  SELECT b.split, b.scope, sum(gap) / any_value(n) AS ece_10
  FROM binned b JOIN sums s ON b.split = s.split AND b.scope = s.scope GROUP BY ALL),
conf_ranks AS (
  SELECT split, scope,
    rank() OVER (PARTITION BY split, scope ORDER BY conf_magnitude)
      + (count(*) OVER (PARTITION BY split, scope, conf_magnitude) - 1) / 2.0 AS rc,
    rank() OVER (PARTITION BY split, scope ORDER BY err)
      + (count(*) OVER (PARTITION BY split, scope, err) - 1) / 2.0 AS re FROM scoped),
conf AS (SELECT split, scope, -corr(rc, re) AS conf_magnitude_score FROM conf_ranks GROUP BY ALL),
ic_ranks AS (
  SELECT split, scope, pred_date,
    rank() OVER (PARTITION BY split, scope, pred_date ORDER BY pred_magnitude_pct)
      + (count(*) OVER (PARTITION BY split, scope, pred_date, pred_magnitude_pct) - 1) / 2.0 AS rp,
    rank() OVER (PARTITION BY split, scope, pred_date ORDER BY abs_a)
      + (count(*) OVER (PARTITION BY split, scope, pred_date, abs_a) - 1) / 2.0 AS ra FROM scoped),
ic_days AS (
  SELECT split, scope, pred_date, count(*) AS n,
    CASE WHEN count(*) >= 3 AND min(rp) < max(rp) AND min(ra) < max(ra) THEN corr(rp, ra) END AS ic
  FROM ic_ranks GROUP BY ALL),
ic AS (
  SELECT split, scope, avg(ic) AS rank_ic, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS rank_ic_t,
    count(ic) AS n_days FROM ic_days GROUP BY ALL),
tenths AS (
  SELECT split, err, greatest(ceil((r - 1) * 10 / (n - 1)), 1) - 1 AS decile FROM (
    SELECT split, err, row_number() OVER (PARTITION BY split ORDER BY conf_magnitude, pred_date, symbol) AS r,
      count(*) OVER (PARTITION BY split) AS n FROM scoped WHERE scope = 'pooled')),
gradient AS (
  SELECT split, 'pooled' AS scope, avg(err) FILTER (decile = 9) AS mae_conf_top_decile,
    avg(err) FILTER (decile = 0) AS mae_conf_bottom_decile,
    avg(err) FILTER (decile = 0) - avg(err) FILTER (decile = 9) AS conf_mag_gradient,
    count(*) FILTER (decile = 9) AS n_top, count(*) FILTER (decile = 0) AS n_bottom
  FROM tenths GROUP BY split),
edges0 AS (
  SELECT split, symbol, count(*) AS n, avg(correct) AS hit, avg((a >= 0)::INT) AS naive,
    avg(correct) - avg((a >= 0)::INT) AS edge
  FROM scoped WHERE scope = 'pooled' GROUP BY split, symbol HAVING count(*) >= 20),
wide AS (
  SELECT split, 'pooled' AS scope, avg((hit > 0.5)::INT) AS frac_stocks_hit_gt_50,
    avg((hit > naive)::INT) AS frac_stocks_beat_naive, count(*) AS n_symbols FROM edges0 GROUP BY split)"""

STATS = SCOPED + """,
everything AS (
  SELECT s.*, 2 * precision_up * recall_up / nullif(precision_up + recall_up, 0) AS f1_up, ece_10,
    conf_magnitude_score, rank_ic, rank_ic_t, n_days, mae_conf_top_decile, mae_conf_bottom_decile,
    conf_mag_gradient, n_top, n_bottom, frac_stocks_hit_gt_50, frac_stocks_beat_naive, n_symbols
  FROM sums s JOIN ece USING (split, scope) JOIN conf USING (split, scope) JOIN ic USING (split, scope)
  LEFT JOIN gradient USING (split, scope) LEFT JOIN wide USING (split, scope)),
statistics AS (
""" + "\n  UNION ALL ".join(
    f"SELECT split, scope, '{m}' AS metric, {m}::DOUBLE AS value, {met.COUNT_COLUMN.get(m, 'n')} AS n_obs "
    f"FROM everything" + (" WHERE scope = 'pooled'" if m in met.POOLED_ONLY else "")
    for m in met.POOLED_METRICS) + ")"


@query("statistics_table", with_(STATS, "SELECT split, scope, metric, round(value, 6) AS value, n_obs FROM statistics"))
def statistics_table(spark, sf):
    return rounded(met.statistics_table(tables.scored_frame(spark, sf)))


def sum_query(name: str, columns: str):
    @query(name, with_(SCOPED, f"SELECT split, scope, n, {round_all(columns)} FROM sums"))
    def run(spark, sf):
        rows = met.scoped_rows(tables.scored_frame(spark, sf))
        return rounded(met.sum_metrics(rows, met.SCOPE_KEYS).select("split", "scope", "n", *columns.split()))
    return run


sum_query("direction_metrics", "direction_score directional_return_pct hit_rate precision_up recall_up")
sum_query("magnitude_metrics", "magnitude_score mae rmse r2_vs_vol")
sum_query("confidence_metrics", "conf_direction_score conf_direction_lift brier brier_skill log_loss")
sum_query("variance_share", "var_share_universe")


@query("ece_bins", with_(SCOPED, """
SELECT split, scope, bin, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(conf_direction), 6) AS mean_conf
FROM (SELECT *, """ + " + ".join(f"(conf_direction >= {e})::INT" for e in met.ECE_EDGES) + """ AS bin FROM scoped)
GROUP BY ALL"""))
def ece_bins(spark, sf):
    rows = met.scoped_rows(tables.scored_frame(spark, sf))
    return rounded(rows.groupBy("split", "scope", met.probability_bin("p").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("p").alias("mean_conf")))


@query("calibration_report", with_(SCOPED, """
SELECT s.split, round(brier, 6) AS brier, round(brier_skill, 6) AS brier_skill, round(log_loss, 6) AS log_loss,
  round(ece_10, 6) AS ece_10, round(m.mean_conf, 6) AS mean_conf, round(hit_rate, 6) AS acc
FROM sums s JOIN ece USING (split, scope)
JOIN (SELECT split, avg(conf_direction) AS mean_conf FROM scored GROUP BY split) m USING (split)
WHERE scope = 'pooled'"""))
def calibration_report(spark, sf):
    rows = met.scoped_rows(tables.scored_frame(spark, sf)).where("scope = 'pooled'")
    return rounded(met.calibration_report(rows, ["split"], "p", "correct"))


@query("spearman_confidence", with_(SCOPED, """
SELECT split, scope, round(conf_magnitude_score, 6) AS conf_magnitude_score FROM conf"""))
def spearman_confidence(spark, sf):
    rows = stage(met.scoped_rows(tables.scored_frame(spark, sf)), "scoped")
    rho = met.spearman(rows, met.SCOPE_KEYS, "c", "err", met.ROW_KEYS, "rho")
    return rounded(rho.select("split", "scope", (-F.col("rho")).alias("conf_magnitude_score")))


@query("rank_ic_daily", with_(SCOPED, """
SELECT split, scope, round(rank_ic, 6) AS rank_ic, round(rank_ic_t, 6) AS rank_ic_t, n_days FROM ic"""))
def rank_ic_daily(spark, sf):
    rows = stage(met.scoped_rows(tables.scored_frame(spark, sf)), "scoped")
    return rounded(met.daily_rank_ic(rows, met.SCOPE_KEYS, "pred_magnitude_pct", "abs_a", met.ROW_KEYS))


@query("decile_gradient", with_(SCOPED, f"""
SELECT split, {round_all('mae_conf_top_decile mae_conf_bottom_decile conf_mag_gradient')}, n_top, n_bottom FROM gradient"""))
def decile_gradient(spark, sf):
    rows = met.scoped_rows(tables.scored_frame(spark, sf)).where("scope = 'pooled'")
    rows = stage(rows.select("split", "pred_date", "symbol", "c", "err"), "scoped")
    return rounded(met.decile_gradient(rows, ["split"], "c", "err", ["split", "pred_date", "symbol"]))


@query("breadth", with_(SCOPED, f"""
SELECT split, {round_all('frac_stocks_hit_gt_50 frac_stocks_beat_naive')}, n_symbols FROM wide"""))
def breadth(spark, sf):
    return rounded(met.breadth(tables.scored_frame(spark, sf), ["split"]))


@query("economic_robustness", with_(SCORED, """
SELECT split, target, scope, round(sum(d * a) / sum(abs(a)), 6) AS direction_score,
  round(avg(d * a) * 100.0, 6) AS directional_return_bps, count(*) AS n_obs
FROM (
  SELECT split, target, d, unnest(['pooled', 'residual']) AS scope, unnest([t, t - m]) AS a
  FROM (SELECT *, avg(t) OVER (PARTITION BY split, target, pred_date) AS m FROM (
    SELECT split, pred_date, pred_direction AS d,
      unnest(['official_close', 'last_trade_1529', 'close_close']) AS target,
      unnest([actual_return_pct, (target_open / session_close - 1.0) * 100.0,
              (target_close / session_close - 1.0) * 100.0]) AS t
    FROM scored) WHERE t IS NOT NULL))
GROUP BY ALL"""))
def economic_robustness(spark, sf):
    return rounded(met.economic_robustness(tables.scored_frame(spark, sf)))


def period_sql(period: str) -> str:
    return with_(SCORED, f"""
SELECT split, CAST(date_trunc('{period}', pred_date) AS DATE) AS period, count(DISTINCT pred_date) AS sessions,
  count(*) AS n_rows, round(sum(pred_direction * actual_return_pct) / sum(abs(actual_return_pct)), 6) AS pooled,
  round(sum(pred_direction * (actual_return_pct - universe_mean_pct))
        / nullif(sum(abs(actual_return_pct - universe_mean_pct)), 0), 6) AS residual,
  round(1 - sum(abs(pred_magnitude_pct - actual_magnitude_pct)) / sum(actual_magnitude_pct), 6) AS magnitude
FROM scored GROUP BY ALL""")


@query("monthly_stability", period_sql("month"))
def monthly_stability(spark, sf):
    return rounded(met.period_stability(tables.scored_frame(spark, sf), "month"))


@query("quarterly_stability", period_sql("quarter"))
def quarterly_stability(spark, sf):
    return rounded(met.period_stability(tables.scored_frame(spark, sf), "quarter"))


@query("symbol_edge", with_(SCOPED, f"SELECT split, symbol, n, {round_all('hit naive edge')} FROM edges0"))
def symbol_edge(spark, sf):
    return rounded(met.symbol_edges(tables.scored_frame(spark, sf), ["split"]))


@query("extreme_edges", with_(SCOPED, """
SELECT symbol, n, round(hit, 6) AS hit, round(naive, 6) AS naive, round(edge, 6) AS edge, side FROM (
  (SELECT *, 'best' AS side FROM edges0 WHERE split = 'test' ORDER BY round(edge, 10) DESC, symbol LIMIT 10)
  UNION ALL
  (SELECT *, 'worst' AS side FROM edges0 WHERE split = 'test' ORDER BY round(edge, 10), symbol LIMIT 10))"""))
def extreme_edges(spark, sf):
    edges = met.symbol_edges(tables.scored_frame(spark, sf), ["split"]).where("split = 'test'").drop("split")
    return rounded(met.extreme_edges(rounded(stage(edges, "edges"), 10)))


@query("edge_persistence", with_(SCOPED, """
SELECT count(*) AS n_symbols, round(corr(rv, rt), 6) AS edge_spearman FROM (
  SELECT rank() OVER (ORDER BY ev) + (count(*) OVER (PARTITION BY ev) - 1) / 2.0 AS rv,
         rank() OVER (ORDER BY et) + (count(*) OVER (PARTITION BY et) - 1) / 2.0 AS rt
  FROM (SELECT v.edge AS ev, t.edge AS et FROM edges0 v JOIN edges0 t ON v.symbol = t.symbol
        WHERE v.split = 'valid' AND t.split = 'test'))"""))
def edge_persistence(spark, sf):
    return rounded(met.edge_persistence(tables.scored_frame(spark, sf)))


@query("return_decomposition", with_(SCORED, """
SELECT split, round(100.0 * avg(pred_direction * actual_return_pct), 6) AS gross_bp,
  round(100.0 * avg(actual_return_pct), 6) AS drift_bp,
  round(100.0 * avg(pred_direction * actual_return_pct) - 100.0 * avg(actual_return_pct), 6) AS incremental_bp,
  round(100.0 * avg(pred_direction * (actual_return_pct - universe_mean_pct)), 6) AS residual_bp,
  round(sum(actual_return_pct) / sum(abs(actual_return_pct)), 6) AS always_up_score
FROM scored GROUP BY split"""))
def return_decomposition(spark, sf):
    return rounded(met.return_decomposition(tables.scored_frame(spark, sf)))


@query("always_up_by_month", with_(TARGETS, """
SELECT CAST(date_trunc('month', pred_date) AS DATE) AS period, count(*) AS n_rows, count(DISTINCT pred_date) AS sessions,
  round(sum(actual_return_pct) / sum(abs(actual_return_pct)), 6) AS direction_score,
  round(avg((actual_return_pct >= 0)::INT), 6) AS up_share
FROM panel0 WHERE actual_return_pct IS NOT NULL GROUP BY ALL"""))
def always_up_by_month(spark, sf):
    """Direction score of the always-up forecast per month: bars, calendar and targets end to end."""
    rows = tables.target_panel(spark, sf).where("actual_return_pct is not null")
    return rounded(rows.groupBy(F.trunc("pred_date", "month").alias("period")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pred_date").alias("sessions"),
        met.direction_score(F.lit(1.0), "actual_return_pct").alias("direction_score"),
        F.avg((F.col("actual_return_pct") >= 0).cast("double")).alias("up_share")))


def rival(scored):
    """A second system: always up, long-run magnitude, its own confidences, without thin histories."""
    from ..functions.columns import hash_fraction

    return scored.where("mag_mean_60 is not null").withColumns({
        "pred_magnitude_pct": F.col("mag_mean_60"), "pred_direction": F.lit(1),
        "conf_direction": 0.5 + 0.5 * hash_fraction(3, "symbol", "pred_date"),
        "conf_magnitude": hash_fraction(4, "symbol", "pred_date")})


RIVALS = SCORED + f""",
shared AS (SELECT * EXCLUDE (universe_mean_pct), avg(actual_return_pct) OVER (PARTITION BY pred_date) AS universe_mean_pct
  FROM scored WHERE split = 'valid' AND mag_mean_60 IS NOT NULL),
systems AS (
  SELECT 'fresh' AS system, * FROM shared
  UNION ALL
  SELECT 'existing', * REPLACE (mag_mean_60 AS pred_magnitude_pct, 1 AS pred_direction,
    0.5 + 0.5 * {fraction(3, 'symbol', 'pred_date')} AS conf_direction,
    {fraction(4, 'symbol', 'pred_date')} AS conf_magnitude) FROM shared)"""


def comparison_sql() -> str:
    """The statistics SQL with the system in place of the split."""
    stats = STATS[len(SCORED):].replace("FROM scored", "FROM contenders").replace("split", "system")
    body = RIVALS + ",\ncontenders AS (SELECT * EXCLUDE (split) FROM systems)" + stats
    return with_(body, """
SELECT scope, metric, round(max(value) FILTER (system = 'fresh'), 6) AS fresh,
  round(max(value) FILTER (system = 'existing'), 6) AS existing,
  round(max(value) FILTER (system = 'fresh') - max(value) FILTER (system = 'existing'), 6) AS delta
FROM statistics GROUP BY scope, metric""")


@query("system_comparison", comparison_sql())
def system_comparison(spark, sf):
    valid = tables.scored_frame(spark, sf).where("split = 'valid'")
    return rounded(met.system_comparison(valid, rival(valid)))


@query("estimand_check", with_(RIVALS, """
SELECT system, round(avg(pred_magnitude_pct), 6) AS mean_pred, round(avg(actual_magnitude_pct), 6) AS mean_actual,
  round(100.0 * (avg(pred_magnitude_pct) / avg(actual_magnitude_pct) - 1.0), 6) AS mean_gap_pct,
  round(regr_slope(actual_magnitude_pct, pred_magnitude_pct), 6) AS calib_slope,
  round(regr_intercept(actual_magnitude_pct, pred_magnitude_pct), 6) AS calib_intercept,
  round(100.0 * avg((actual_magnitude_pct > pred_magnitude_pct)::INT), 6) AS pct_above
FROM systems GROUP BY system"""))
def estimand_check(spark, sf):
    valid = tables.scored_frame(spark, sf).where("split = 'valid'")
    first, second = met.common_rows(valid, rival(valid))
    cols = ["pred_magnitude_pct", "actual_magnitude_pct"]
    both = first.select(F.lit("fresh").alias("system"), *cols).unionByName(
        second.select(F.lit("existing").alias("system"), *cols))
    return rounded(met.estimand_check(both, ["system"], *cols))


@query("lambda_grid", with_(SCORED, """
SELECT "lambda", round(sum(d * actual_return_pct) / sum(abs(actual_return_pct)), 6) AS pooled_ds,
  round(sum(d * e) / sum(abs(e)), 6) AS residual_ds,
  round(avg(((CASE WHEN actual_return_pct >= 0 THEN 1 ELSE -1 END) = d)::INT), 6) AS hit,
  round(avg((d > 0)::INT), 6) AS frac_long
FROM (SELECT *, actual_return_pct - universe_mean_pct AS e,
        CASE WHEN pred_direction + "lambda" * coalesce(mag_mean_5 - mag_mean_20, 0) / 100.0 >= 0 THEN 1 ELSE -1 END AS d
      FROM scored, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.25]::DOUBLE[]) AS "lambda"))
GROUP BY "lambda" """))
def lambda_grid(spark, sf):
    rows = tables.scored_frame(spark, sf).select(
        F.col("pred_direction").cast("double").alias("mu_market"),
        (tables.short_minus_long() / 100.0).alias("mu_residual"), "actual_return_pct",
        (F.col("actual_return_pct") - F.col("universe_mean_pct")).alias("resid_target"))
    return rounded(met.shrinkage_table(rows, [0.0, 0.25, 0.5, 0.75, 1.0, 1.25], "mu_market", "mu_residual"))


@query("direction_diagnostic", with_(SCORED + """,
rows0 AS (
  SELECT *, coalesce(mag_mean_5 - mag_mean_20, 0) AS score, actual_return_pct - universe_mean_pct AS e,
    CASE WHEN coalesce(mag_mean_5 - mag_mean_20, 0) >= 0 THEN 1 ELSE -1 END AS d FROM scored),
by_symbol AS (
  SELECT split, symbol, avg(((CASE WHEN actual_return_pct >= 0 THEN 1 ELSE -1 END) = d)::INT) AS hit,
    avg((actual_return_pct >= 0)::INT) AS naive FROM rows0 GROUP BY ALL HAVING count(*) >= 20),
ranks AS (
  SELECT split, pred_date, rank() OVER (PARTITION BY pred_date ORDER BY score)
      + (count(*) OVER (PARTITION BY pred_date, score) - 1) / 2.0 AS rs,
    rank() OVER (PARTITION BY pred_date ORDER BY e)
      + (count(*) OVER (PARTITION BY pred_date, e) - 1) / 2.0 AS re FROM rows0),
days AS (
  SELECT split, pred_date, CASE WHEN count(*) >= 2 AND min(rs) < max(rs) AND min(re) < max(re) THEN corr(rs, re) END AS ic
  FROM ranks GROUP BY ALL)""", """
SELECT split, round(sum(d * actual_return_pct) / sum(abs(actual_return_pct)), 6) AS pooled_direction_score,
  round(sum(d * e) / sum(abs(e)), 6) AS residual_direction_score,
  round(avg(((CASE WHEN actual_return_pct >= 0 THEN 1 ELSE -1 END) = d)::INT), 6) AS hit_rate,
  round(avg((d > 0)::INT), 6) AS fraction_long,
  (SELECT round(avg((hit > naive)::INT), 6) FROM by_symbol b WHERE b.split = r.split) AS frac_stocks_beat_naive,
  (SELECT round(avg(ic), 6) FROM days y WHERE y.split = r.split) AS residual_rank_ic
FROM rows0 r GROUP BY split"""))
def direction_diagnostic(spark, sf):
    rows = tables.scored_frame(spark, sf).select(
        "split", "symbol", "pred_date", tables.short_minus_long().alias("score"),
        "actual_return_pct", (F.col("actual_return_pct") - F.col("universe_mean_pct")).alias("resid_target"))
    return rounded(met.direction_diagnostic(rows, ["split"], "score", ["split", "pred_date", "symbol"]))


RELIABILITY = SCORED + """,
candidates AS (
  SELECT 'confidence' AS model, pred_date, symbol, conf_magnitude AS conf, pred_magnitude_pct AS mag,
    abs(pred_magnitude_pct - actual_magnitude_pct) AS err FROM scored WHERE split = 'test'
  UNION ALL
  SELECT 'neg_magnitude', pred_date, symbol, -pred_magnitude_pct, pred_magnitude_pct,
    abs(pred_magnitude_pct - actual_magnitude_pct) FROM scored WHERE split = 'test'),
placed AS (
  SELECT *, greatest(ceil((rm - 1) * 10 / (n - 1)), 1) - 1 AS mdec, greatest(ceil((rcf - 1) * 10 / (n - 1)), 1) - 1 AS cdec
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mag, model, pred_date, symbol) AS rm,
          row_number() OVER (PARTITION BY model ORDER BY conf, model, pred_date, symbol) AS rcf,
          count(*) OVER (PARTITION BY model) AS n FROM candidates)),
ranks AS (
  SELECT *,
    rank() OVER (PARTITION BY model ORDER BY conf) + (count(*) OVER (PARTITION BY model, conf) - 1) / 2.0 AS rc,
    rank() OVER (PARTITION BY model ORDER BY err) + (count(*) OVER (PARTITION BY model, err) - 1) / 2.0 AS re,
    rank() OVER (PARTITION BY model ORDER BY mag) + (count(*) OVER (PARTITION BY model, mag) - 1) / 2.0 AS rg,
    rank() OVER (PARTITION BY model, mdec ORDER BY conf)
      + (count(*) OVER (PARTITION BY model, mdec, conf) - 1) / 2.0 AS wc,
    rank() OVER (PARTITION BY model, mdec ORDER BY err)
      + (count(*) OVER (PARTITION BY model, mdec, err) - 1) / 2.0 AS we FROM placed)"""


def reliability_table(spark, sf):
    test = tables.scored_frame(spark, sf).where("split = 'test'")
    both = F.explode(F.array(
        F.struct(F.lit("confidence").alias("model"), F.col("conf_magnitude").alias("conf")),
        F.struct(F.lit("neg_magnitude").alias("model"), (-F.col("pred_magnitude_pct")).alias("conf"))))
    rows = test.select("pred_date", "symbol", F.col("pred_magnitude_pct").alias("mag"),
                       F.abs(F.col("pred_magnitude_pct") - F.col("actual_magnitude_pct")).alias("err"),
                       both.alias("_b")).select("pred_date", "symbol", "mag", "err", "_b.*")
    return met.reliability_report(rows, ["model"], "conf", "err", "mag", ["model", "pred_date", "symbol"])


@query("reliability_report", with_(RELIABILITY, """
SELECT model, round(-corr(rc, re), 6) AS conf_magnitude_score, round(corr(rc, rg), 6) AS corr_with_magnitude,
  (SELECT round(avg(rho), 6) FROM (SELECT model, -corr(wc, we) AS rho FROM ranks GROUP BY model, mdec) w
   WHERE w.model = r.model) AS within_magnitude_decile,
  round(avg(err) FILTER (cdec = 9), 6) AS mae_top_decile, round(avg(err) FILTER (cdec = 0), 6) AS mae_bottom_decile,
  round(avg(err) FILTER (cdec = 0) - avg(err) FILTER (cdec = 9), 6) AS conf_mag_gradient
FROM ranks r GROUP BY model"""))
def reliability_report(spark, sf):
    """Confidence against the negative-magnitude baseline, overall and within magnitude deciles."""
    return rounded(reliability_table(spark, sf))


@query("select_magnitude_confidence", with_(RELIABILITY, f"""
SELECT model, round(score, 6) AS conf_magnitude_score, round(within, 6) AS within_magnitude_decile
FROM (SELECT model, -corr(rc, re) AS score FROM ranks GROUP BY model)
JOIN (SELECT model, avg(rho) AS within
      FROM (SELECT model, -corr(wc, we) AS rho FROM ranks GROUP BY model, mdec) GROUP BY model) USING (model)
QUALIFY score >= max(score) OVER () - {selection.TIE_BAND}
ORDER BY within DESC, model LIMIT 1"""))
def select_magnitude_confidence(spark, sf):
    """The better candidate within magnitude deciles, of those within the tie band of the best overall."""
    return rounded(selection.select_magnitude_confidence(reliability_table(spark, sf)).select(
        "model", "conf_magnitude_score", "within_magnitude_decile"))
