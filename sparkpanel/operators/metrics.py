"""Scoring metrics of direction, magnitude and confidence forecasts.

Both scopes (pooled returns and returns net of the session mean) and all splits are
scored together: one aggregate for everything that is a sum, one ranking pass for the
Spearman scores and one for the daily rank correlations.  Only group-level tables are
joined afterwards.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import ratio, sign_up
from ..sources.staging import stage
from .ranking import average_ranks, decile_of, positions, running_weight

# fixed values: metric names in their published order
POOLED_METRICS = [
    "direction_score", "directional_return_pct", "magnitude_score", "conf_direction_score",
    "conf_direction_lift", "conf_magnitude_score", "hit_rate", "precision_up", "recall_up",
    "f1_up", "brier", "brier_skill", "log_loss", "ece_10", "mae", "rmse", "rank_ic",
    "rank_ic_t", "r2_vs_vol", "mae_conf_top_decile", "mae_conf_bottom_decile",
    "conf_mag_gradient", "frac_stocks_hit_gt_50", "frac_stocks_beat_naive", "var_share_universe",
]
POOLED_ONLY = {
    "mae", "rmse", "r2_vs_vol", "mae_conf_top_decile", "mae_conf_bottom_decile", "conf_mag_gradient",
    "frac_stocks_hit_gt_50", "frac_stocks_beat_naive", "var_share_universe",
}
RESIDUAL_METRICS = [m for m in POOLED_METRICS if m not in POOLED_ONLY]
ECE_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
CLIP = 1e-6


# ---- expressions -----------------------------------------------------------------
def direction_score(d: str | Column, a: str | Column) -> Column:
    d, a = (F.col(c) if isinstance(c, str) else c for c in (d, a))
    return ratio(F.sum(d * a), F.sum(F.abs(a)))


def magnitude_score(m: str | Column, actual: str | Column) -> Column:
    m, actual = (F.col(c) if isinstance(c, str) else c for c in (m, actual))
    return 1 - ratio(F.sum(F.abs(m - actual)), F.sum(actual))


def hit(d: str, a: str) -> Column:
    """1.0 when the forecast sign equals the outcome sign (zero counts as up)."""
    return (sign_up(a) == F.col(d)).cast("double")


def probability_bin(p: str) -> Column:
    """Equal-width bin 0..9, left-closed; 1.0 belongs to the last bin."""
    bins = F.lit(0)
    for edge in ECE_EDGES:
        bins = bins + (F.col(p) >= F.lit(edge)).cast("int")
    return bins


def calibration_error(p: str, correct: str) -> Column:
    """Expected calibration error over ten bins as one aggregate expression.

    A bin contributes |sum of (outcome - probability)| / n, so ten conditional sums do.
    """
    bins, gap = probability_bin(p), F.col(correct) - F.col(p)
    parts = [F.abs(F.coalesce(F.sum(F.when(bins == k, gap)), F.lit(0.0))) for k in range(10)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total / F.count(p)


def brier(p: str, correct: str) -> Column:
    return F.avg((F.col(p) - F.col(correct)) * (F.col(p) - F.col(correct)))


def log_loss(p: str, correct: str) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    return -F.avg(F.col(correct) * F.ln(q) + (1 - F.col(correct)) * F.ln(1 - q))


def rank_correlation(a: str, b: str, least: int = 3) -> Column:
    """Pearson correlation of two rank columns; null for fewer than ``least`` rows or a constant."""
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)) & (F.count(F.lit(1)) >= least)
    # corr() raises on a constant input in ANSI mode
    return F.when(varied, ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


# ---- grouped reports ---------------------------------------------------------------
def spearman(df: DataFrame, groups: list[str], a: str, b: str, row_keys: list[str], out: str = "spearman",
             least: int = 3) -> DataFrame:
    """Spearman correlation with average ties per group of any size."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *dict.fromkeys([*row_keys, *groups, a, b]))
    ranked = average_ranks(both, groups, [a, b], row_keys, prefix="_rk_")
    return ranked.groupBy(*groups).agg(rank_correlation(f"_rk_{a}", f"_rk_{b}", least).alias(out))


def daily_rank_ic(df: DataFrame, groups: list[str], pred: str, actual: str, row_keys: list[str],
                  least: int = 3) -> DataFrame:
    """Per session Spearman, then mean, t-statistic and number of sessions per group."""
    keys = list(dict.fromkeys([*groups, "pred_date"]))
    daily = spearman(df, keys, pred, actual, row_keys, "_ic", least)
    n, mean, sd = F.count("_ic"), F.avg("_ic"), F.stddev_samp("_ic")
    return daily.groupBy(*groups).agg(
        F.when(n >= 2, mean).alias("rank_ic"),
        F.when(n >= 2, ratio(mean * F.sqrt(n.cast("double")), sd)).alias("rank_ic_t"),
        n.alias("n_days"))


def with_decile(df: DataFrame, groups: list[str], value: str, row_keys: list[str], out: str) -> DataFrame:
    """Equal-count decile of ``value`` in its group; ties are ordered by the row keys."""
    placed = positions(df, groups, [value, *row_keys], row_keys, "_pos", "_size")
    return placed.withColumn(out, decile_of(F.col("_pos"), F.col("_size"))).drop("_pos", "_size")


def with_deciles(df: DataFrame, groups: list[str], outs: dict[str, str], row_keys: list[str]) -> DataFrame:
    """``with_decile`` for several (value, name) columns, all placed in one range partition."""
    keys = [*groups, "_c"]
    order = F.struct(F.col("_e._v"), *row_keys)
    long = df.select(*dict.fromkeys([*row_keys, *groups]), F.explode(F.array(*[
        F.struct(F.lit(out).alias("_c"), F.col(value).cast("double").alias("_v")) for value, out in outs.items()])).alias("_e")
    ).select("*", "_e._c", order.alias("_k"), F.lit(1).alias("n")).drop("_e")
    placed = running_weight(long, keys, "_k", out="_pos", total="_size")
    decile = decile_of(F.col("_pos"), F.col("_size"))
    wide = placed.groupBy(*row_keys).agg(*[F.max(F.when(F.col("_c") == out, decile)).alias(out) for out in outs.values()])
    return df.join(wide, row_keys, "left")


def decile_gradient(df: DataFrame, groups: list[str], conf: str, err: str, row_keys: list[str]) -> DataFrame:
    """Mean error in the most and least confident decile; a constant confidence uses all rows."""
    return gradient_of_deciles(with_decile(df, groups, conf, row_keys, "_decile"), groups, conf, err, "_decile")


def gradient_of_deciles(tenths: DataFrame, groups: list[str], conf: str, err: str, decile: str) -> DataFrame:
    """``decile_gradient`` of rows that have the decile of their confidence."""
    varied = F.min(conf) < F.max(conf)
    top, bottom = F.col(decile) == 9, F.col(decile) == 0
    part = lambda cond: F.when(varied, F.avg(F.when(cond, F.col(err)))).otherwise(F.avg(err))
    size = lambda cond: F.when(varied, F.count_if(cond)).otherwise(F.count(err))
    return tenths.groupBy(*groups).agg(
        part(top).alias("mae_conf_top_decile"), part(bottom).alias("mae_conf_bottom_decile"),
        (part(bottom) - part(top)).alias("conf_mag_gradient"),
        size(top).alias("n_top"), size(bottom).alias("n_bottom"))


def breadth(df: DataFrame, groups: list[str], d: str = "pred_direction", a: str = "actual_return_pct",
            least: int = 20) -> DataFrame:
    """Share of symbols with a hit rate above one half and above their own share of up days."""
    per = symbol_edges(df, groups, d, a, least)
    return per.groupBy(*groups).agg(
        F.avg((F.col("hit") > 0.5).cast("double")).alias("frac_stocks_hit_gt_50"),
        F.avg((F.col("hit") > F.col("naive")).cast("double")).alias("frac_stocks_beat_naive"),
        F.count(F.lit(1)).alias("n_symbols"))


def symbol_edges(df: DataFrame, groups: list[str], d: str = "pred_direction", a: str = "actual_return_pct",
                 least: int = 20) -> DataFrame:
    """Hit rate, share of up days and their difference per symbol with at least ``least`` rows."""
    per = df.groupBy(*groups, "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit(d, a)).alias("hit"),
        F.avg((F.col(a) >= 0).cast("double")).alias("naive"))
    return per.where(F.col("n") >= least).withColumn("edge", F.col("hit") - F.col("naive"))


def calibration_report(df: DataFrame, groups: list[str], q: str, correct: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        brier(q, correct).alias("brier"),
        (1 - ratio(brier(q, correct), F.var_pop(correct))).alias("brier_skill"),
        log_loss(q, correct).alias("log_loss"), calibration_error(q, correct).alias("ece_10"),
        F.avg(q).alias("mean_conf"), F.avg(correct).alias("acc"))


def reliability_report(df: DataFrame, groups: list[str], conf: str, err: str, mag: str,
                       row_keys: list[str]) -> DataFrame:
    """Rank agreement of a confidence with small errors: overall, within magnitude deciles, gradient."""
    rows = stage(df.select(*dict.fromkeys([*groups, *row_keys, conf, err, mag])), "reliability")
    ranked = average_ranks(rows, groups, [conf, err, mag], row_keys, prefix="_rk_")
    overall = ranked.groupBy(*groups).agg(
        (-rank_correlation(f"_rk_{conf}", f"_rk_{err}", 2)).alias("conf_magnitude_score"),
        rank_correlation(f"_rk_{conf}", f"_rk_{mag}", 2).alias("corr_with_magnitude"))
    tenths = stage(with_deciles(rows, groups, {mag: "_mag_decile", conf: "_conf_decile"}, row_keys), "deciles")
    within = spearman(tenths, [*groups, "_mag_decile"], conf, err, row_keys, "_rho", 2)
    within = within.groupBy(*groups).agg((-F.avg("_rho")).alias("within_magnitude_decile"))
    slope = gradient_of_deciles(tenths, groups, conf, err, "_conf_decile").select(
        *groups, F.col("mae_conf_top_decile").alias("mae_top_decile"),
        F.col("mae_conf_bottom_decile").alias("mae_bottom_decile"), "conf_mag_gradient")
    join = (lambda a, b: a.join(b, groups)) if groups else (lambda a, b: a.crossJoin(b))
    return join(join(overall, within), slope)


# ---- the statistics table -----------------------------------------------------------
SCOPE_KEYS = ["split", "scope"]
ROW_KEYS = ["split", "scope", "pred_date", "symbol"]


def scoped_rows(df: DataFrame, groups: tuple[str, ...] = ("split",)) -> DataFrame:
    """Each row once per scope with outcome a, |a|, hit indicator, error and confidence weight."""
    if "vol_baseline_20" not in df.columns:
        df = df.withColumn("vol_baseline_20", F.lit(None).cast("double"))
    raw, mean = F.col("actual_return_pct"), F.col("universe_mean_pct")
    scopes = F.explode(F.array(
        F.struct(F.lit("pooled").alias("scope"), raw.alias("a")),
        F.struct(F.lit("residual").alias("scope"), (raw - mean).alias("a"))))
    rows = df.select(
        *groups, "pred_date", "symbol", "pred_magnitude_pct", F.col("pred_direction").cast("double").alias("d"),
        F.col("conf_direction").alias("p"), F.col("conf_magnitude").alias("c"), "actual_return_pct",
        "universe_mean_pct", "vol_baseline_20", scopes.alias("_s")).select("*", "_s.scope", "_s.a").drop("_s")
    return rows.select(
        "*", F.abs("a").alias("abs_a"), hit("d", "a").alias("correct"),
        F.abs(F.col("pred_magnitude_pct") - F.abs("a")).alias("err"), (2 * F.col("p") - 1).alias("w"))


def sum_metrics(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Every metric that is an aggregate of row expressions, one pass over scoped rows."""
    m, v, a = F.col("pred_magnitude_pct"), F.col("vol_baseline_20"), F.col("abs_a")
    sq = lambda x: x * x
    has_v = v.isNotNull()
    up, a_up = F.col("d") == 1, F.col("a") >= 0
    agg = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        direction_score("d", "a").alias("direction_score"),
        F.avg(F.col("d") * F.col("a")).alias("directional_return_pct"),
        magnitude_score("pred_magnitude_pct", "abs_a").alias("magnitude_score"),
        ratio(F.sum(F.col("w") * F.col("d") * F.col("a")), F.sum(F.col("w") * a)).alias("conf_direction_score"),
        F.avg("correct").alias("hit_rate"),
        F.avg(F.when(up, a_up.cast("double"))).alias("precision_up"),
        F.avg(F.when(a_up, up.cast("double"))).alias("recall_up"),
        F.count_if(up).alias("n_up"), F.count_if(a_up).alias("n_actual_up"),
        brier("p", "correct").alias("brier"),
        (1 - ratio(brier("p", "correct"), F.var_pop("correct"))).alias("brier_skill"),
        log_loss("p", "correct").alias("log_loss"), calibration_error("p", "correct").alias("ece_10"),
        F.avg("err").alias("mae"), F.sqrt(F.avg(sq(m - a))).alias("rmse"),
        (1 - ratio(F.sum(F.when(has_v, sq(m - a))), F.sum(F.when(has_v, sq(v - a))))).alias("r2_vs_vol"),
        F.count(v).alias("n_vol"),
        (1 - ratio(F.var_pop(F.col("actual_return_pct") - F.col("universe_mean_pct")),
                   F.var_pop("actual_return_pct"))).alias("var_share_universe"),
    )
    pr, rc = F.col("precision_up"), F.col("recall_up")
    return agg.select(
        "*", (F.col("conf_direction_score") - F.col("direction_score")).alias("conf_direction_lift"),
        ratio(2 * pr * rc, pr + rc).alias("f1_up"))


def metric_values(df: DataFrame, groups: tuple[str, ...] = ("split",)) -> DataFrame:
    """Wide table: one row per (group, scope) with all metric values and their row counts."""
    keys = [*groups, "scope"]
    row_keys = [*groups, "scope", "pred_date", "symbol"]
    rows = stage(scoped_rows(df, groups), "scoped")
    pooled = rows.where("scope = 'pooled'")
    conf = spearman(rows, keys, "c", "err", row_keys, "_rho").select(
        *keys, (-F.col("_rho")).alias("conf_magnitude_score"))
    ic = daily_rank_ic(rows, keys, "pred_magnitude_pct", "abs_a", row_keys)
    tag = lambda t: t.withColumn("scope", F.lit("pooled"))
    deciles = tag(decile_gradient(pooled, list(groups), "c", "err", [*groups, "pred_date", "symbol"]))
    wide = tag(breadth(pooled.select(*groups, "symbol", F.col("d").alias("pred_direction"), "actual_return_pct"),
                       list(groups)))
    return (
        sum_metrics(rows, keys).join(conf, keys, "left").join(ic, keys, "left")
        .join(deciles, keys, "left").join(wide, keys, "left"))


# metrics whose observation count is not the number of rows
COUNT_COLUMN = {
    "precision_up": "n_up", "recall_up": "n_actual_up", "rank_ic": "n_days", "rank_ic_t": "n_days",
    "r2_vs_vol": "n_vol", "mae_conf_top_decile": "n_top", "mae_conf_bottom_decile": "n_bottom",
    "frac_stocks_hit_gt_50": "n_symbols", "frac_stocks_beat_naive": "n_symbols",
}


def long_metrics(wide: DataFrame, groups: tuple[str, ...] = ("split",)) -> DataFrame:
    """(group, scope, metric, value, n_obs): 25 pooled and 16 residual rows per group."""
    entries = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                 F.coalesce(F.col(COUNT_COLUMN.get(m, "n")), F.lit(0)).cast("bigint").alias("n_obs"))
        for m in POOLED_METRICS]))
    long = wide.select(*groups, "scope", entries.alias("_e")).select(*groups, "scope", "_e.*")
    return long.where((F.col("scope") == "pooled") | F.col("metric").isin(RESIDUAL_METRICS))


def statistics_table(df: DataFrame, groups: tuple[str, ...] = ("split",)) -> DataFrame:
    return long_metrics(metric_values(df, groups), groups)


# ---- robustness and report tables ------------------------------------------------------
# fixed values: columns of the scored table
ROBUSTNESS_COLUMNS = {
    "split", "pred_date", "pred_direction", "actual_return_pct", "session_close", "target_open", "target_close",
}


def economic_robustness(df: DataFrame) -> DataFrame:
    """Direction score and return of the emitted direction on three targets and two scopes."""
    missing = ROBUSTNESS_COLUMNS - set(df.columns)
    if missing:
        raise KeyError(f"the robustness table needs {', '.join(sorted(missing))}")
    later = lambda c: (ratio(c, "session_close") - 1.0) * 100.0
    targets = F.explode(F.array(*[
        F.struct(F.lit(name).alias("target"), value.cast("double").alias("value")) for name, value in (
            ("official_close", F.col("actual_return_pct")),
            ("last_trade_1529", later("target_open")), ("close_close", later("target_close")))]))
    rows = df.select("split", "pred_date", F.col("pred_direction").cast("double").alias("d"), targets.alias("_t")).select(
        "split", "pred_date", "d", "_t.target", F.col("_t.value").alias("t")).where("t is not null and not isnan(t)")
    rows = stage(rows, "robustness")
    means = stage(rows.groupBy("split", "target", "pred_date").agg(F.avg("t").alias("mean")), "target-means")
    scopes = F.explode(F.array(
        F.struct(F.lit("pooled").alias("scope"), F.col("t").alias("a")),
        F.struct(F.lit("residual").alias("scope"), (F.col("t") - F.col("mean")).alias("a"))))
    return (
        rows.join(means, ["split", "target", "pred_date"])
        .select("split", "target", "d", scopes.alias("_s")).select("split", "target", "d", "_s.scope", "_s.a")
        .groupBy("split", "target", "scope")
        .agg(direction_score("d", "a").alias("direction_score"),
             (F.avg(F.col("d") * F.col("a")) * 100.0).alias("directional_return_bps"),
             F.count(F.lit(1)).alias("n_obs")))


def period_stability(df: DataFrame, period: str) -> DataFrame:
    """Sessions, pooled and residual direction score and magnitude score per month or quarter."""
    start = F.trunc("pred_date", period).alias("period")
    resid = F.col("actual_return_pct") - F.col("universe_mean_pct")
    return df.groupBy("split", start).agg(
        F.count_distinct("pred_date").alias("sessions"), F.count(F.lit(1)).alias("n_rows"),
        direction_score("pred_direction", "actual_return_pct").alias("pooled"),
        direction_score(F.col("pred_direction"), resid).alias("residual"),
        magnitude_score("pred_magnitude_pct", "actual_magnitude_pct").alias("magnitude"))


def extreme_edges(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k best and k worst symbols by edge (a top-k report)."""
    best = edges.orderBy(F.desc("edge"), "symbol").limit(k).withColumn("side", F.lit("best"))
    worst = edges.orderBy("edge", "symbol").limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def edge_persistence(df: DataFrame, first: str = "valid", second: str = "test") -> DataFrame:
    """Spearman correlation of the symbols' edges in two splits."""
    edges = stage(symbol_edges(df, ["split"]), "edges")
    pick = lambda s, name: edges.where(F.col("split") == s).select("symbol", F.col("edge").alias(name))
    both = stage(pick(first, "first_edge").join(pick(second, "second_edge"), "symbol"), "edge-pairs")
    rho = spearman(both, [], "first_edge", "second_edge", ["symbol"], "edge_spearman")
    return both.agg(F.count(F.lit(1)).alias("n_symbols")).crossJoin(rho)


def return_decomposition(df: DataFrame) -> DataFrame:
    """Gross, drift, incremental and residual return per session in basis points, with always-up."""
    bp = lambda x: 100.0 * F.avg(x)
    d, a = F.col("pred_direction"), F.col("actual_return_pct")
    resid = a - F.col("universe_mean_pct")
    return df.groupBy("split").agg(
        bp(d * a).alias("gross_bp"), bp(a).alias("drift_bp"), (bp(d * a) - bp(a)).alias("incremental_bp"),
        bp(d * resid).alias("residual_bp"), direction_score(F.lit(1.0), a).alias("always_up_score"))


def semantic_gate(df: DataFrame, groups: list[str], pred: str, actual: str, max_gap_pct: float = 5.0,
                  slope_low: float = 0.7, slope_high: float = 1.4) -> DataFrame:
    """Is the level right: gap of the means and slope of outcome on forecast, with pass flags."""
    both = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    agg = both.groupBy(*groups).agg(
        F.avg(pred).alias("mean_pred"), F.avg(actual).alias("mean_actual"),
        (100.0 * (ratio(F.avg(pred), F.avg(actual)) - 1.0)).alias("mean_gap_pct"),
        F.regr_slope(actual, pred).alias("calib_slope"), F.regr_intercept(actual, pred).alias("calib_intercept"))
    return agg.select(
        "*", (F.abs("mean_gap_pct") <= max_gap_pct).alias("passes_mean_gate"),
        F.col("calib_slope").between(slope_low, slope_high).alias("passes_slope_gate"))


def estimand_check(df: DataFrame, groups: list[str], pred: str, actual: str) -> DataFrame:
    """Mean gap, linear calibration and how often the outcome exceeds the forecast."""
    gate = semantic_gate(df, groups, pred, actual).drop("passes_mean_gate", "passes_slope_gate")
    above = df.groupBy(*groups).agg((100.0 * F.avg((F.col(actual) > F.col(pred)).cast("double"))).alias("pct_above"))
    return gate.join(above, groups)


def common_rows(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("pred_date", "symbol")) -> tuple[DataFrame, DataFrame]:
    """Both systems on their shared rows, with the outcome and session mean of the first."""
    k = list(keys)
    truth = ["actual_return_pct", "actual_magnitude_pct"]
    shared = a.join(b.select(*k), k, "left_semi").drop("universe_mean_pct")
    shared = stage(shared, "shared")
    means = stage(shared.groupBy("pred_date").agg(F.avg("actual_return_pct").alias("universe_mean_pct")), "shared-mean")
    first = shared.join(means, "pred_date")
    second = b.drop("universe_mean_pct", *truth).join(first.select(*k, *truth, "universe_mean_pct"), k)
    return first, second


def system_comparison(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("fresh", "existing")) -> DataFrame:
    """Metric table of two systems on their common rows with the difference."""
    first, second = common_rows(a, b)
    cols = ["pred_date", "symbol", "pred_magnitude_pct", "pred_direction", "conf_direction", "conf_magnitude",
            "actual_return_pct", "universe_mean_pct", "vol_baseline_20"]
    tag = lambda t, name: t.select(F.lit(name).alias("system"), *cols)
    stats = statistics_table(tag(first, names[0]).unionByName(tag(second, names[1])), ("system",))
    return stats.groupBy("scope", "metric").pivot("system", list(names)).agg(F.first("value")).select(
        "scope", "metric", *names, (F.col(names[0]) - F.col(names[1])).alias("delta"))


def shrinkage_table(df: DataFrame, grid: list[float], market: str, residual: str,
                    a: str = "actual_return_pct", e: str = "resid_target") -> DataFrame:
    """Scores of sign(market + lambda * residual) for every lambda of the grid.

    The grid is a parameter of a handful of numbers and is expanded inside each row.
    """
    rows = df.select(market, residual, a, e, F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("lambda"))
    rows = rows.withColumn("d", sign_up(F.col(market) + F.col("lambda") * F.col(residual)))
    return rows.groupBy("lambda").agg(
        direction_score("d", a).alias("pooled_ds"), direction_score("d", e).alias("residual_ds"),
        F.avg(hit("d", a)).alias("hit"), F.avg((F.col("d") > 0).cast("double")).alias("frac_long"))


def direction_diagnostic(df: DataFrame, groups: list[str], score: str, row_keys: list[str],
                         a: str = "actual_return_pct", e: str = "resid_target") -> DataFrame:
    """Summary of a direction score: scores, hit rate, breadth, residual rank correlation, share long."""
    rows = stage(df.select(*dict.fromkeys([*groups, *row_keys, "symbol", "pred_date", score, a, e])).withColumn(
        "d", sign_up(score)), "diagnostic")
    base = rows.groupBy(*groups).agg(
        direction_score("d", a).alias("pooled_direction_score"),
        direction_score("d", e).alias("residual_direction_score"), F.avg(hit("d", a)).alias("hit_rate"),
        F.avg((F.col("d") > 0).cast("double")).alias("fraction_long"))
    wide = breadth(rows, groups, "d", a).select(*groups, "frac_stocks_beat_naive")
    daily = spearman(rows, [*groups, "pred_date"], score, e, row_keys, "_ic", 2)
    ic = daily.groupBy(*groups).agg(F.avg("_ic").alias("residual_rank_ic"))
    return base.join(wide, groups, "left").join(ic, groups, "left")
