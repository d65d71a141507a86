"""Magnitude forecasts: candidate registry, out-of-fold tournament, blend and validation table."""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import calibration as calib, glm, learners, linear
from ..operators.quality import require_finite
from ..sources.staging import stage

# fixed values: inputs of the small ridge model
RIDGE_INPUTS = ["mag_lag_1", "mag_mean_5", "mag_mean_20", "mag_mean_60", "mag_ewm_20",
                "mag_std_20", "mag_median_20", "rv_full_pct", "rv_final_30_pct", "rv_mean_20",
                "mkt_rv", "mkt_ret_disp", "mkt_on_mean_20", "calendar_gap_days",
                "range_pct", "log_dollar_volume", "bench_gap_abs"]
BASELINE, BLEND = "M0_trailing20", "M5_oof_blend"
GAMMA_FLOOR = 1e-4
KEYS = ["pred_date", "symbol"]
TARGET = "actual_magnitude_pct"


@dataclass(frozen=True)
class MagnitudeConfig:
    ridge_alphas: tuple[float, ...] = (10.0, 100.0, 1000.0, 10000.0)
    tweedie_powers: tuple[float, ...] = (1.1, 1.3, 1.5)
    tree: dict = field(default_factory=lambda: dict(max_iter=100, depth=5, step=0.05, min_leaf=200))
    forest: dict = field(default_factory=lambda: dict(trees=20, depth=6, min_leaf=200))
    min_train_rows: int = 5000
    parallel_fits: int = 4
    seed: int = 42


def _non_negative(predict: learners.Predictor) -> learners.Predictor:
    def run(df: DataFrame, out: str) -> DataFrame:
        return predict(df, out).withColumn(out, F.greatest(out, F.lit(0.0)))
    return run


def _smeared(train: DataFrame, log_predict: learners.Predictor) -> learners.Predictor:
    """Forecast of log1p(y) back on the scale of y with the training smearing factor."""
    fitted = log_predict(train.withColumn("_log_y", F.log1p(TARGET)), "_log_p")
    smear = float(fitted.agg(calib.smearing_factor("_log_y", "_log_p")).first()[0])

    def run(df: DataFrame, out: str) -> DataFrame:
        return log_predict(df, out).withColumn(out, calib.from_log1p(out, smear))
    return run


def fit_trailing(train: DataFrame, features: list[str], cfg: MagnitudeConfig) -> learners.Predictor:
    return lambda df, out: df.withColumn(out, F.col("mag_mean_20"))


@dataclass(frozen=True)
class RidgeCandidate:
    """Ridge of log1p(y) with smearing; ``inputs`` picks its columns from the panel's."""

    inputs: Callable[[list[str]], list[str]]

    def __call__(self, train: DataFrame, features: list[str], cfg: MagnitudeConfig) -> learners.Predictor:
        model = linear.fit_ridge_grid(train, self.inputs(features), F.log1p(TARGET), list(cfg.ridge_alphas))
        return _smeared(train, lambda df, out: df.withColumn(out, model.predict()))

    def over_folds(self, train: DataFrame, folds: list, features: list[str], cfg: MagnitudeConfig) -> learners.Predictor:
        """The fold's own model for the rows of each fold: all folds are fitted, smeared and applied in one pass each."""
        ends = [f.train_end for f in folds]
        models = linear.fit_ridge_folds(train, ends, self.inputs(features), F.log1p(TARGET), list(cfg.ridge_alphas))
        factors = train.select("pred_date", F.log1p(TARGET).alias("_y"), *[m.predict().alias(f"_p{i}") for i, m in enumerate(models)]).agg(*[
            calib.smearing_factor("_y", F.when(F.col("pred_date") <= F.lit(end), F.col(f"_p{i}"))).alias(f"s{i}") for i, end in enumerate(ends)]).first()

        def run(df: DataFrame, out: str) -> DataFrame:
            value = F.lit(None).cast("double")
            for i, (f, model) in enumerate(zip(folds, models)):
                mine = F.col("pred_date").between(F.lit(f.predict_start), F.lit(f.predict_end))
                value = F.when(mine, calib.from_log1p(model.predict(), float(factors[f"s{i}"]))).otherwise(value)
            return df.withColumn(out, value)
        return run


@dataclass(frozen=True)
class MeanCandidate:
    """Log-link mean of y; those of one fold are fitted in shared passes."""

    mean: glm.Mean

    def __call__(self, train: DataFrame, features: list[str], cfg: MagnitudeConfig) -> learners.Predictor:
        return glm.fit_means(train, features, F.col(TARGET), {"mean": self.mean})["mean"]


def fit_log_trees(train: DataFrame, features: list[str], cfg: MagnitudeConfig) -> learners.Predictor:
    return _smeared(train, learners.fit_boosted_trees(train, features, F.log1p(TARGET), seed=cfg.seed, **cfg.tree))


def fit_direct_trees(train: DataFrame, features: list[str], cfg: MagnitudeConfig) -> learners.Predictor:
    return _non_negative(learners.fit_boosted_trees(train, features, F.col(TARGET), seed=cfg.seed, **cfg.tree))


def fit_shadow_quantile(train: DataFrame, features: list[str], cfg: MagnitudeConfig) -> learners.Predictor:
    """A 45 % quantile of log1p(y): score-optimised sensitivity, never selected as a mean."""
    forest = learners.fit_quantile_forest(
        train, features, F.log1p(TARGET), [0.45], KEYS, seed=cfg.seed, **cfg.forest)
    return lambda df, out: forest(df, "_q45").withColumn(
        out, F.greatest(F.expm1(F.col("_q45")[0]), F.lit(0.0))).drop("_q45")


def candidates(cfg: MagnitudeConfig) -> dict[str, Callable]:
    """name -> fit(train, features, cfg); extend or subset the dictionary to change the tournament."""
    out = {
        BASELINE: fit_trailing,
        "M1_harx_ridge_smear": RidgeCandidate(lambda cols: RIDGE_INPUTS),
        "M2_gamma": MeanCandidate(glm.Mean(glm.POWERS["gamma"], GAMMA_FLOOR)),
        "M4_trees_logl2_smear": fit_log_trees,
        "M6_trees_l2_direct": fit_direct_trees,
        "M7_poisson": MeanCandidate(glm.Mean(glm.POWERS["poisson"])),
        "M8_harx_full_ridge": RidgeCandidate(lambda cols: cols),
        "S_quantile45_shadow": fit_shadow_quantile,
    }
    for p in cfg.tweedie_powers:
        out[f"M3_tweedie_{p}"] = MeanCandidate(glm.Mean(p))
    return out


def mean_models(names: list[str]) -> list[str]:
    return [n for n in names if not n.startswith("S_") and n not in (BASELINE, BLEND)]


def _scored(predict: learners.Predictor, rows: DataFrame, name: str) -> DataFrame:
    out = predict(rows, "pred").select(F.lit(name).alias("model"), *KEYS, F.col("pred").cast("double"), TARGET,
                                       "mag_mean_20")
    out = stage(out, "forecasts")
    require_finite(out, ["pred"], name)
    return out


def _in_parallel(jobs: list[Callable[[], DataFrame]], workers: int) -> list[DataFrame]:
    """Independent fits are separate Spark jobs; a few at a time keep the executors busy."""
    if workers <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(lambda job: job(), jobs))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _means(past: DataFrame, rows: DataFrame, features: list[str], means: dict[str, glm.Mean]) -> DataFrame:
    return _union([_scored(model, rows, name) for name, model in glm.fit_means(past, features, F.col(TARGET), means).items()])


def oof_forecasts(train: DataFrame, folds: DataFrame, registry: dict[str, Callable], features: list[str],
                  cfg: MagnitudeConfig) -> DataFrame:
    """Long out-of-fold forecasts (model, pred_date, symbol, pred, outcome, baseline).

    ``train`` should be a staged table: each fold is a date filter pushed to its scan.  Candidates that can fit all
    folds in one pass (``over_folds``) do so.
    """
    jobs, usable, at_once = [], [], {n: f for n, f in registry.items() if hasattr(f, "over_folds")}
    means = {n: f.mean for n, f in registry.items() if isinstance(f, MeanCandidate)}
    for fold in folds.orderBy("fold").collect():  # a handful of rows: the fold definitions
        past = train.where(F.col("pred_date") <= F.lit(fold.train_end))
        rows = train.where(F.col("pred_date").between(F.lit(fold.predict_start), F.lit(fold.predict_end)))
        if past.count() < cfg.min_train_rows:
            continue
        usable.append(fold)
        if means:
            jobs.append(lambda past=past, rows=rows: _means(past, rows, features, means))
        for name, fit in registry.items():
            if name not in at_once and name not in means:
                jobs.append(lambda past=past, rows=rows, name=name, fit=fit:
                            _scored(fit(past, features, cfg), rows, name))
    if not usable:
        raise ValueError("no fold has enough training rows")
    ranges = reduce(lambda a, b: a | b, [F.col("pred_date").between(F.lit(f.predict_start), F.lit(f.predict_end)) for f in usable])
    jobs += [lambda name=name, fit=fit: _scored(fit.over_folds(train, usable, features, cfg), train.where(ranges), name)
             for name, fit in at_once.items()]
    return _union(_in_parallel(jobs, cfg.parallel_fits))


def wide_forecasts(long: DataFrame, models: list[str]) -> DataFrame:
    return long.groupBy(*KEYS).pivot("model", models).agg(F.max("pred")).join(
        long.groupBy(*KEYS).agg(F.max(TARGET).alias(TARGET), F.max("mag_mean_20").alias("mag_mean_20")), KEYS)


def with_blend(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Append the blend as one more model; rows lacking one of its members have no blend."""
    wide = wide_forecasts(long, list(weights))
    blend = wide.select(F.lit(BLEND).alias("model"), *KEYS, calib.blended(weights).alias("pred"), TARGET, "mag_mean_20")
    return long.unionByName(blend.where("pred is not null"))


@dataclass(frozen=True)
class Tournament:
    oof: DataFrame
    valid: DataFrame
    weights: dict[str, float]
    table: DataFrame


def validation_table(oof: DataFrame, valid: DataFrame) -> DataFrame:
    """Raw and calibrated candidates on validation; the calibration line comes from the OOF rows only."""
    lines = stage(calib.affine_calibration(oof, ["model"], "pred", TARGET), "calibration-lines")
    rows = valid.join(lines, "model")
    variants = F.explode(F.array(
        F.struct(F.lit("raw").alias("variant"), F.col("pred").alias("p")),
        F.struct(F.lit("calibrated").alias("variant"),
                 calib.apply_affine("pred", F.col("calib_a0"), F.col("calib_b")).alias("p"))))
    rows = stage(rows.select("model", *KEYS, TARGET, "mag_mean_20", variants.alias("v")).select(
        "model", *KEYS, TARGET, "mag_mean_20", "v.variant", F.col("v.p").alias("pred")), "variants")
    table = calib.candidate_table(
        rows, ["model", "variant"], "pred", TARGET, "mag_mean_20", ["model", "variant", *KEYS])
    return table.join(lines, "model")


def tournament(panel: DataFrame, folds: DataFrame, registry: dict[str, Callable], features: list[str],
               cfg: MagnitudeConfig = MagnitudeConfig()) -> Tournament:
    """Out-of-fold forecasts inside train, blend weights, then one refit scored on validation."""
    train, valid = panel.where("split = 'train'"), panel.where("split = 'valid'")
    oof = stage(oof_forecasts(train, folds, registry, features, cfg), "magnitude-oof")
    means = {n: f.mean for n, f in registry.items() if isinstance(f, MeanCandidate)}
    refits = [lambda name=name, fit=fit: _scored(fit(train, features, cfg), valid, name)
              for name, fit in registry.items() if name not in means]
    if means:
        refits.append(lambda: _means(train, valid, features, means))
    scored = _union(_in_parallel(refits, cfg.parallel_fits))
    members = mean_models(list(registry))
    weights: dict[str, float] = {}
    if members:
        weights = calib.blend_weights(wide_forecasts(oof, members), members, TARGET)
        oof, scored = with_blend(oof, weights), with_blend(scored, weights)
    oof, scored = stage(oof, "oof"), stage(scored, "valid-forecasts")
    return Tournament(oof, scored, weights, validation_table(oof, scored))
