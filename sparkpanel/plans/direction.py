"""Direction forecasts: market leg, residual leg, conditional quantiles, shrinkage and ablation."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import sign_up
from ..functions.distribution import LEVELS, crossings, distribution_features, prob_up, rearranged
from ..operators import bootstrap as boot, cross_section as cs, learners, linear, metrics as met
from ..operators.selection import select_shrinkage
from ..sources.staging import stage
from .magnitude import _in_parallel, _union

# fixed values: inputs of the market model
MARKET_INPUTS = [
    "mkt_ret_oc", "mkt_ret_cc", "mkt_rv", "mkt_rv_disp", "mkt_ret_disp", "mkt_final60",
    "mkt_breadth_up", "mkt_near_high", "mkt_bench_gap",
    "mkt_on_lag_1", "mkt_on_lag_2", "mkt_on_mean_20", "mkt_on_mean_60",
    "mkt_on_pos_share_20", "mkt_on_std_20", "calendar_gap_days", "weekday", "is_long_gap",
]
KEYS = ["pred_date", "symbol"]


@dataclass(frozen=True)
class DirectionConfig:
    market_alphas: tuple[float, ...] = (100.0, 300.0, 1000.0, 3000.0, 10000.0)
    shrinkage: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25)
    levels: tuple[float, ...] = tuple(LEVELS)
    tree: dict = field(default_factory=lambda: dict(max_iter=100, depth=5, step=0.05, min_leaf=200))
    forest: dict = field(default_factory=lambda: dict(trees=20, depth=6, min_leaf=300))
    block_sessions: int = 5
    draws: int = 2000
    parallel_fits: int = 4
    seed: int = 42


def market_frame(panel: DataFrame, inputs: list[str] = MARKET_INPUTS) -> DataFrame:
    """One row per session: mean outcome and the market inputs (equal for all rows of a session)."""
    return panel.groupBy("pred_date").agg(
        F.avg("actual_return_pct").alias("mkt_target"), *[F.max(c).alias(c) for c in inputs])


def fit_market(train: DataFrame, cfg: DirectionConfig, inputs: list[str] = MARKET_INPUTS) -> linear.Ridge:
    sessions = stage(market_frame(train, inputs), "market-frame")
    return linear.fit_ridge_grid(sessions, inputs, F.col("mkt_target"), list(cfg.market_alphas))


def fit_residual(train: DataFrame, features: list[str], cfg: DirectionConfig) -> learners.Predictor:
    rows = cs.demeaned(train.drop("resid_target", "universe_mean_pct"))
    return learners.fit_boosted_trees(rows, features, F.col("resid_target"), seed=cfg.seed, **cfg.tree)


def fit_quantiles(train: DataFrame, features: list[str], cfg: DirectionConfig) -> learners.Predictor:
    return learners.fit_quantile_forest(
        train, features, F.col("actual_return_pct"), list(cfg.levels), KEYS, seed=cfg.seed, **cfg.forest)


def fit_legs(train: DataFrame, features: list[str], cfg: DirectionConfig,
             market_inputs: list[str] = MARKET_INPUTS, quantiles: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Fit all legs; the result adds mu_market, market_alpha, mu_residual and the raw and rearranged quantiles.

    Market inputs are constant within a session, so the market model is applied to rows
    directly and no session table has to be joined back.
    """
    market = fit_market(train, cfg, market_inputs)
    residual = fit_residual(train, features, cfg)
    forest = fit_quantiles(train, features, cfg) if quantiles else None

    def apply(df: DataFrame) -> DataFrame:
        out = residual(df.withColumns({"mu_market": market.predict(), "market_alpha": F.lit(float(market.alpha))}), "mu_residual")
        if forest is not None:
            out = forest(out, "q_raw").withColumn("q", rearranged("q_raw"))
        return out
    return apply


def direction_store(scored: DataFrame, lam: float, cfg: DirectionConfig) -> DataFrame:
    """Total forecast, P(up) and distribution features; what the confidence plans read."""
    features = distribution_features("q", list(cfg.levels))
    return scored.select(
        *KEYS, "split", "actual_return_pct", "resid_target", "actual_magnitude_pct", "mu_market", "mu_residual",
        (F.col("mu_market") + lam * F.col("mu_residual")).alias("mu_total"),
        crossings("q_raw").alias("crossings"), prob_up("q", list(cfg.levels)).alias("p_up"),
        *[v.alias(k) for k, v in features.items()])


@dataclass(frozen=True)
class Direction:
    oof: DataFrame
    valid: DataFrame
    shrinkage_table: DataFrame
    shrinkage: float


def _apply(train: DataFrame, rows: DataFrame, features: list[str], cfg: DirectionConfig, **kw) -> DataFrame:
    keep = [*KEYS, "split", "actual_return_pct", "resid_target", "actual_magnitude_pct", "mu_market", "market_alpha",
            "mu_residual"]
    out = fit_legs(train, features, cfg, **kw)(rows)
    return stage(out.select(*keep, *[c for c in ("q_raw", "q") if c in out.columns]), "direction-legs")


def research(panel: DataFrame, folds: DataFrame, features: list[str],
             cfg: DirectionConfig = DirectionConfig()) -> Direction:
    """Out-of-fold legs, shrinkage chosen on them only, refit on train and scored on validation."""
    panel = stage(cs.demeaned(panel.drop("universe_mean_pct")), "direction-panel")
    train, valid = panel.where("split = 'train'"), panel.where("split = 'valid'")
    jobs = []
    for fold in folds.orderBy("fold").collect():  # a handful of rows: the fold definitions
        past = train.where(F.col("pred_date") <= F.lit(fold.train_end))
        rows = train.where(F.col("pred_date").between(F.lit(fold.predict_start), F.lit(fold.predict_end)))
        jobs.append(lambda past=past, rows=rows: _apply(past, rows, features, cfg))
    jobs.append(lambda: _apply(train, valid, features, cfg))
    *oof_parts, valid_legs = _in_parallel(jobs, cfg.parallel_fits)
    oof = _union(oof_parts)
    table = stage(met.shrinkage_table(oof, list(cfg.shrinkage), "mu_market", "mu_residual"), "shrinkage")
    lam = float(select_shrinkage(table).first()["lambda"])
    return Direction(stage(direction_store(oof, lam, cfg), "direction-oof"),
                     stage(direction_store(valid_legs, lam, cfg), "direction-valid"), table, lam)


def quantile_features(panel: DataFrame, folds: DataFrame, features: list[str],
                      cfg: DirectionConfig = DirectionConfig()) -> DataFrame:
    """Distribution features of every row that comes after a fit: out of fold within train, by the fit on train in validation."""
    train = panel.where("split = 'train'")
    blocks = [(train.where(F.col("pred_date") <= F.lit(f.train_end)),
               train.where(F.col("pred_date").between(F.lit(f.predict_start), F.lit(f.predict_end))))
              for f in folds.orderBy("fold").collect()]  # a handful of rows: the fold definitions
    blocks.append((train, panel.where("split = 'valid'")))

    def applied(past: DataFrame, rows: DataFrame) -> DataFrame:
        out = fit_quantiles(past, features, cfg)(rows, "q_raw").withColumn("q", rearranged("q_raw"))
        found = distribution_features("q", list(cfg.levels))
        return stage(out.select(*KEYS, *[v.alias(k) for k, v in found.items()]), "quantile-features")
    return _union(_in_parallel([lambda past=past, rows=rows: applied(past, rows) for past, rows in blocks], cfg.parallel_fits))


def benchmark_ablation(panel: DataFrame, features: list[str], lam: float,
                       cfg: DirectionConfig = DirectionConfig()) -> DataFrame:
    """Validation diagnostics with and without the benchmark-basis columns and their paired intervals."""
    panel = stage(cs.demeaned(panel.drop("universe_mean_pct")), "ablation-panel")
    train, valid = panel.where("split = 'train'"), panel.where("split = 'valid'")
    reduced = [c for c in features if "bench_gap" not in c]
    inputs = [c for c in MARKET_INPUTS if c != "mkt_bench_gap"]
    full, ablated = _in_parallel([
        lambda: _apply(train, valid, features, cfg, quantiles=False),
        lambda: _apply(train, valid, reduced, cfg, quantiles=False, market_inputs=inputs)], cfg.parallel_fits)
    total = (F.col("mu_market") + lam * F.col("mu_residual")).alias("score")
    tag = lambda t, name: t.select(F.lit(name).alias("model"), *KEYS, "actual_return_pct", "resid_target", "market_alpha", total)
    names = ("full_assignment_features", "economic_sensitivity_no_benchmark_basis")
    rows = stage(tag(full, names[0]).unionByName(tag(ablated, names[1])), "ablation")
    table = met.direction_diagnostic(rows, ["model"], "score", ["model", *KEYS]).join(
        rows.groupBy("model").agg(F.max("market_alpha").alias("market_alpha")), "model")
    pairs = stage(rows.groupBy(*KEYS).agg(
        F.max("actual_return_pct").alias("pooled"), F.max("resid_target").alias("residual"),
        *[F.max(F.when(F.col("model") == n, F.col("score"))).alias(f"s{i}") for i, n in enumerate(names)]), "pairs")
    for scope in ("pooled", "residual"):
        interval = boot.direction_diff(
            pairs, sign_up("s0"), sign_up("s1"), F.col(scope), block_sessions=cfg.block_sessions,
            draws=cfg.draws, seed=cfg.seed)
        table = table.crossJoin(interval.select(*[
            F.col(c).alias(f"full_minus_ablated_{scope}_{c}") for c in ("mean", "ci_low", "ci_high")]))
    return table
