"""Log-link means of the Tweedie family by iteratively reweighted least squares.

A round is one Newton step and one pass: each task reduces its rows to the weighted cross products of the standardised inputs
and to the deviance at the current weights; Spark adds them up and only k x k sums, for k inputs, reach the driver.  All means of a call
share the pass.  A step that would raise the penalised deviance is halved until it does not, so heavy-tailed
outcomes slow a fit down but cannot throw it off.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage
from .linear import Scaler, column_matrix, fit_imputer, fit_scaler

#: Power of the variance in the mean.
POWERS = {"poisson": 1.0, "gamma": 2.0}
#: The linear predictor stays inside; exp() of it neither overflows nor vanishes.
REACH = 50.0


@dataclass(frozen=True)
class Mean:
    """What to fit: Var(y) proportional to mean ** power; outcomes below ``floor`` count as it."""

    power: float
    floor: float | None = None
    penalty: float = 1e-3


@dataclass
class Fit:
    mean: Mean
    weights: np.ndarray
    deviances: list[float] = field(default_factory=list)
    steps: int = 0
    converged: bool = False


def unit_deviance(y: np.ndarray, mu: np.ndarray, power: float) -> np.ndarray:
    if power == 1:
        return 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))
    if power == 2:
        return 2 * (y / mu - 1 - np.log(y / mu))
    return 2 * (np.where(y > 0, y, 0) ** (2 - power) / ((1 - power) * (2 - power)) - y * mu ** (1 - power) / (1 - power)
                + mu ** (2 - power) / (2 - power))


def _sums(z: np.ndarray, y: np.ndarray, mean: Mean, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Deviance, X'WX and X'Wz of the rows at the given weights."""
    if mean.floor is not None:
        y = np.maximum(y, mean.floor)
    eta = np.clip(z @ weights, -REACH, REACH)
    mu = np.exp(eta)
    # second and first derivative of half the deviance; it is convex in the linear predictor for powers from 1 to 2
    w = (2 - mean.power) * mu ** (2 - mean.power) + (mean.power - 1) * y * mu ** (1 - mean.power)
    slope = (y - mu) * mu ** (1 - mean.power)
    return float(unit_deviance(y, mu, mean.power).sum()), (z * w[:, None]).T @ z, z.T @ (w * eta + slope)


def _pass(data: DataFrame, means: list[Mean], weights: list[np.ndarray], k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The sums of all rows for each mean, in one job."""
    upper = np.triu_indices(k)
    size = 1 + len(upper[0]) + k

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(means), size))
        for batch in batches:
            rows = column_matrix(batch)
            for m, (mean, w) in enumerate(zip(means, weights)):
                deviance, gram, right = _sums(rows[:, :-1], rows[:, -1], mean, w)
                total[m] += np.r_[deviance, gram[upper], right]
        # an input without spread is 0 in every row; cells of 0 need not travel
        m, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(m.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[m, at])], names=["m", "at", "v"])

    cells = np.zeros((len(means), size))
    sums = data.mapInArrow(partial, "m int, at int, v double").groupBy("m", "at").agg(F.sum("v").alias("v")).toArrow()
    cells[sums["m"].to_numpy(), sums["at"].to_numpy()] = sums["v"].to_numpy()
    out = []
    for row in cells:
        gram = np.zeros((k, k))
        gram[upper] = row[1:1 + len(upper[0])]
        out.append((row[0], gram + np.triu(gram, 1).T, row[1 + len(upper[0]):]))
    return out


def fit_weights(data: DataFrame, means: list[Mean], k: int, n: int, start: list[float], max_iter: int = 50, tol: float = 1e-9) -> list[Fit]:
    """Weights per mean; ``data`` has k columns, the first of ones, and the outcome.

    Minimises deviance / (2 n) + penalty / 2 * |weights without the first|^2.  ``deviances`` are the penalised ones, round
    by round; they never rise.
    """
    shrink = [np.r_[0.0, np.full(k - 1, n * m.penalty)] for m in means]
    fits = [Fit(m, np.r_[s, np.zeros(k - 1)]) for m, s in zip(means, start)]
    trial = [f.weights for f in fits]
    halvings = [0] * len(fits)
    for _ in range(max_iter):
        open_ = [i for i, f in enumerate(fits) if not f.converged]
        if not open_:
            break
        sums = _pass(data, [means[i] for i in open_], [trial[i] for i in open_], k)
        for i, (deviance, gram, right) in zip(open_, sums):
            fit, value = fits[i], deviance + float(shrink[i] @ trial[i] ** 2)
            last = fit.deviances[-1] if fit.deviances else np.inf
            if not np.isfinite(value) or value > last:
                halvings[i] += 1
                fit.converged = halvings[i] > 30 or value - last <= tol * abs(last)
                trial[i] = (trial[i] + fit.weights) / 2
                continue
            fit.converged = last - value <= tol * (abs(value) + 1e-300)
            fit.weights, halvings[i] = trial[i], 0
            fit.deviances.append(value)
            fit.steps += 1
            trial[i] = np.linalg.lstsq(gram + np.diag(shrink[i]), right, rcond=None)[0]
    return fits


def fit_means(train: DataFrame, features: list[str], target: Column, means: dict[str, Mean], max_iter: int = 50) -> dict[str, "MeanModel"]:
    """A model per named mean; median imputation with indicators and standardisation are shared."""
    scaler = fit_scaler(train, fit_imputer(train, features, indicators=True))
    inputs = [F.lit(1.0), *scaler.columns()]
    data = stage(train.where(target.isNotNull() & ~F.isnan(target.cast("double"))).select(
        *[c.alias(f"x{i}") for i, c in enumerate(inputs)], target.cast("double").alias("y")), "glm-train")
    names = list(means)
    level = data.agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.greatest("y", F.lit(means[m].floor)) if means[m].floor is not None else F.col("y")).alias(f"m{i}")
        for i, m in enumerate(names)]).first()
    start = [float(np.log(max(level[f"m{i}"], 1e-12))) for i in range(len(names))]
    fits = fit_weights(data, [means[m] for m in names], len(inputs), level.n, start, max_iter)
    return {m: MeanModel(scaler, f) for m, f in zip(names, fits)}


@dataclass(frozen=True)
class MeanModel:
    """Adds the mean; ``fit`` holds the penalty and the deviance of each round."""

    scaler: Scaler
    fit: Fit

    @property
    def penalty(self) -> float:
        return self.fit.mean.penalty

    def expression(self) -> Column:
        total = F.lit(float(self.fit.weights[0]))
        for c, w in zip(self.scaler.columns(), self.fit.weights[1:]):
            total = total + c * float(w)
        return F.exp(F.greatest(F.least(total, F.lit(REACH)), F.lit(-REACH)))

    def __call__(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.expression())


def fit_glm(train: DataFrame, features: list[str], target: Column, family: str, power: float | None = None,
            floor: float | None = None, penalty: float = 1e-3, max_iter: int = 50) -> MeanModel:
    """One gamma, Poisson or Tweedie mean."""
    mean = Mean(POWERS[family] if power is None else power, floor, penalty)
    return fit_means(train, features, target, {family: mean}, max_iter)[family]
