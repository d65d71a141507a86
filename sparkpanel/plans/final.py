"""Final scoring: models fitted on train serve train and validation, refits on both serve the test block."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.confidence import flip_rule
from ..operators import calibration as calib, cross_section as cs, metrics as met
from ..operators.quality import target_mismatches
from ..sources.staging import stage
from . import confidence as conf, direction as dirn, magnitude as mag

KEYS = ["pred_date", "symbol"]


@dataclass(frozen=True)
class Selection:
    """What the research stages chose."""

    magnitude: str
    variant: str
    weights: dict[str, float]
    shrinkage: float
    direction_confidence: str
    magnitude_confidence: str


def _forecast(fit_rows: DataFrame, rows: DataFrame, choice: Selection, registry, features: list[str],
              cfg: mag.MagnitudeConfig) -> DataFrame:
    """The selected magnitude model (or blend) fitted on one block and applied to another."""
    weights = {n: w for n, w in choice.weights.items() if w} if choice.magnitude == mag.BLEND else {choice.magnitude: 1.0}
    names = [f"_m{i}" for i in range(len(weights))]
    jobs = [lambda name=name: registry[name](fit_rows, features, cfg) for name in weights]
    out = rows
    for c, predict in zip(names, mag._in_parallel(jobs, cfg.parallel_fits)):
        out = predict(out, c)
    return out.withColumn("raw_magnitude", calib.blended(dict(zip(names, weights.values())))).drop(*names)


def _published_scale(oof: DataFrame, choice: Selection):
    """Calibration line of the selected model, fitted on out-of-fold rows only."""
    line = calib.affine_calibration(oof.where(F.col("model") == choice.magnitude), [], "pred", mag.TARGET).first()

    def scale(c: str) -> Column:
        if choice.variant == "calibrated":
            return calib.apply_affine(c, float(line.calib_a0), float(line.calib_b))
        return F.greatest(F.col(c), F.lit(0.0))
    return scale


def score_all(panel: DataFrame, tournament: mag.Tournament, direction: dirn.Direction, choice: Selection,
              features: list[str], registry, mcfg: mag.MagnitudeConfig = mag.MagnitudeConfig(),
              dcfg: dirn.DirectionConfig = dirn.DirectionConfig(), seed: int = 42, **tree) -> DataFrame:
    """The four published forecasts for every scorable row of all splits."""
    bad = target_mismatches(panel).first()
    if bad.mismatches:
        raise AssertionError(f"target reconstruction failed for {bad.mismatches} rows")
    panel = stage(cs.demeaned(panel.drop("universe_mean_pct", "resid_target")), "final-panel")
    train = panel.where("split = 'train'")
    early, test = panel.where("split in ('train', 'valid')"), panel.where("split = 'test'")

    scale = _published_scale(tournament.oof, choice)
    fits = ((train, early), (early, test))
    jobs = [lambda past=past, rows=rows: dirn._apply(past, rows, features, dcfg) for past, rows in fits]
    jobs += [lambda past=past, rows=rows: _forecast(past, rows, choice, registry, features, mcfg).select(*KEYS, "raw_magnitude")
             for past, rows in fits]
    *legs, early_magnitude, test_magnitude = mag._in_parallel(jobs, mcfg.parallel_fits)
    magnitude = stage(mag._union([early_magnitude, test_magnitude]).withColumn("pred_magnitude_pct", scale("raw_magnitude")), "final-magnitude")
    legs = mag._union(legs)
    store = stage(dirn.direction_store(legs, choice.shrinkage, dcfg), "final-direction")

    oof_magnitude = tournament.oof.where(F.col("model") == choice.magnitude).select(
        *KEYS, scale("pred").alias("pred_magnitude_pct"))
    train_c = stage(conf.direction_inputs(direction.oof, panel, oof_magnitude), "final-confidence-train")
    train_c = train_c.where("p_up_emitted is not null and mu_total is not null and abs_mu is not null")
    rows_c = stage(conf.direction_inputs(store, panel, magnitude), "final-confidence")
    d, p = flip_rule("base_direction", "q")
    emitted = conf.DIRECTION_CANDIDATES[choice.direction_confidence](train_c)(rows_c, "q").select(
        *KEYS, "pred_magnitude_pct", d.cast("int").alias("pred_direction"), p.alias("conf_direction"))

    train_d = stage(conf.reliability_training(direction.oof, panel, oof_magnitude), "final-reliability-train")
    rows_d = stage(calib.attach_error_history(conf.error_rows(store, panel, magnitude), train_d), "final-reliability")
    reliable = conf.magnitude_confidences(train_d, rows_d, seed, [choice.magnitude_confidence], **tree).select(
        *KEYS, F.col("confidence").alias("conf_magnitude"))
    truth = panel.select(*KEYS, "target_date", "split", "session_close", "target_open", "target_close",
                         "actual_return_pct", "actual_magnitude_pct", "universe_mean_pct")
    return stage(truth.join(emitted, KEYS).join(reliable, KEYS), "final-scored")


def final_tables(scored: DataFrame) -> dict[str, DataFrame]:
    return {"statistics": met.statistics_table(scored), "robustness": met.economic_robustness(scored)}
