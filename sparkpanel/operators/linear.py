"""Imputation, standardisation and ridge regression from distributed cross products.

Each task reduces its rows to one small cross-product matrix; Spark sums the matrices
and only the k x k result (k = number of features) reaches the driver for the solve.
The same matrices serve every penalty of a grid.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .calendar import chronological_cut
from .ranking import quantiles


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians; columns without any value get 0.

    All columns go through one long (column, value) form that is range-partitioned.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("e")).select("e.*").where("value is not null")
    found = {r["column"]: float(r["quantile"]) for r in quantiles(long, ["column"], "value", [0.5]).collect()}
    return {c: found.get(c, 0.0) for c in columns}


@dataclass(frozen=True)
class Imputer:
    """Median fill, optionally with an indicator for every column that had gaps in training."""

    features: tuple[str, ...]
    fill: dict[str, float]
    flagged: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*self.features, *[f"missing_{c}" for c in self.flagged]]

    def columns(self) -> list[Column]:
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(self.fill[c])) for c in self.features]
        return filled + [F.col(c).isNull().cast("double") for c in self.flagged]

    def centred(self) -> list[Column]:
        """Columns minus their fill value, so that a gap is simply zero."""
        shifted = [F.coalesce(F.col(c).cast("double") - F.lit(self.fill[c]), F.lit(0.0)) for c in self.features]
        return shifted + [F.col(c).isNull().cast("double") for c in self.flagged]


def fit_imputer(df: DataFrame, features: list[str], indicators: bool = False) -> Imputer:
    fill = column_medians(df, features)
    flagged: tuple[str, ...] = ()
    if indicators:
        gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
        flagged = tuple(c for c in features if gaps[c])
    return Imputer(tuple(features), fill, flagged)


def column_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of numeric columns as a matrix; a missing value is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, batch.num_columns))


def grouped_products(df: DataFrame, columns: list[Column], group: Column, groups: int) -> np.ndarray:
    """(groups, k, k) cross products Z'Z of the given columns, by a group number; rows without one count nowhere.

    Tasks hold one matrix per group; what reaches the driver is set by columns and groups.
    """
    k = len(columns)
    upper = np.triu_indices(k)
    size = len(upper[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, k, k))
        for batch in batches:
            rows = column_matrix(batch)
            at, z = rows[:, 0].astype(int), rows[:, 1:]
            for g in np.unique(at).tolist():
                part = z[at == g]
                total[g] += part.T @ part
        seen = np.flatnonzero(total[:, 0, 0] != 0) if k else np.zeros(0, int)
        values = total[seen][:, upper[0], upper[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(seen, size).astype(np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(seen))), pa.array(values.ravel())],
            names=["g", "at", "v"])

    wide = df.where(group.isNotNull()).select(group.cast("double").alias("_g"), *[c.cast("double").alias(f"_z{i}") for i, c in enumerate(columns)])
    cells = wide.mapInArrow(partial, "g int, at int, v double").groupBy("g", "at").agg(F.sum("v").alias("v"))
    out = np.zeros((groups, k, k))
    for r in cells.collect():
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[r.g, i, j] = out[r.g, j, i] = r.v
    return out


def cross_products(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Z'Z of the given columns over all rows; the first column is never 0."""
    return grouped_products(df, columns, F.lit(0), 1)[0]


@dataclass(frozen=True)
class Products:
    """Cross products of [1, centred features, target] over a set of rows.

    Features are centred at the imputer's fill values, which keeps the sums well scaled;
    means, deviations and the standardised normal equations follow by algebra.
    """

    z: np.ndarray

    @property
    def rows(self) -> float:
        return float(self.z[0, 0])

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean (about the centre) and population deviation; constant columns get deviation 1."""
        mean = self.z[0, 1:-1] / self.rows
        second = np.diag(self.z)[1:-1] / self.rows
        variance = second - mean ** 2
        return mean, np.where(variance > 1e-12 * np.maximum(second, 1e-300), np.sqrt(np.maximum(variance, 0)), 1.0)

    def solve(self, alpha: float) -> tuple[np.ndarray, float]:
        """Ridge weights of the centred features on their own scale, penalised as if standardised."""
        mean, scale = self.moments()
        target = self.z[0, -1] / self.rows
        gram = (self.z[1:-1, 1:-1] - self.rows * np.outer(mean, mean)) / np.outer(scale, scale)
        right = (self.z[1:-1, -1] - self.rows * mean * target) / scale
        weights = np.linalg.solve(gram + alpha * np.eye(len(mean)), right) / scale
        return weights, target - mean @ weights

    def mean_squared_error(self, weights: np.ndarray, intercept: float) -> float:
        w = np.concatenate([[intercept], weights, [-1.0]])
        return float(w @ self.z @ w / self.rows)


def products(df: DataFrame, imputer: Imputer, target: Column) -> Products:
    return Products(cross_products(df, [F.lit(1.0), *imputer.centred(), target.cast("double")]))


@dataclass(frozen=True)
class Ridge:
    imputer: Imputer
    weights: np.ndarray
    intercept: float
    alpha: float

    def predict(self) -> Column:
        terms = [c * float(w) for c, w in zip(self.imputer.centred(), self.weights)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))


@dataclass(frozen=True)
class Scaler:
    """Imputed columns, centred and divided by the population deviation."""

    imputer: Imputer
    mean: np.ndarray
    scale: np.ndarray

    def columns(self) -> list[Column]:
        return [(c - float(m)) / float(s) for c, m, s in zip(self.imputer.centred(), self.mean, self.scale)]


def fit_scaler(df: DataFrame, imputer: Imputer) -> Scaler:
    mean, scale = products(df, imputer, F.lit(0.0)).moments()
    return Scaler(imputer, mean, scale)


def fit_ridge(df: DataFrame, features: list[str], target: Column, alpha: float, indicators: bool = False) -> Ridge:
    imputer = fit_imputer(df, features, indicators)
    weights, intercept = products(df, imputer, target).solve(alpha)
    return Ridge(imputer, weights, intercept, alpha)


def choose_alpha(df: DataFrame, features: list[str], target: Column, alphas: list[float],
                 fraction: float = 0.8) -> float:
    """Penalty with the smallest error on the last part of the rows in time order.

    One fit and one evaluation matrix serve the whole grid.
    """
    cut = F.lit(chronological_cut(df, fraction).first().cut.date())
    early, late = df.where(F.col("pred_date") <= cut), df.where(F.col("pred_date") > cut)
    imputer = fit_imputer(early, features)
    fit, check = products(early, imputer, target), products(late, imputer, target)
    if not check.rows:
        return alphas[-1]
    errors = [check.mean_squared_error(*fit.solve(a)) for a in alphas]
    return alphas[int(np.argmin(errors))]


def fit_ridge_grid(df: DataFrame, features: list[str], target: Column, alphas: list[float]) -> Ridge:
    return fit_ridge(df, features, target, choose_alpha(df, features, target, alphas))


# ---- expanding folds in one pass -----------------------------------------------------
@dataclass(frozen=True)
class GapProducts:
    """Cross products of [1, features or 0, gap marks, target], from which those for any fill values follow.

    Features are less a common centre, which keeps the sums well scaled.
    """

    centre: np.ndarray
    z: np.ndarray

    def filled(self, fill: np.ndarray) -> Products:
        """Products of [1, features less their fill value, target] with gaps at the fill value."""
        k, shift = len(fill), fill - self.centre
        t = np.zeros((k + 2, 2 * k + 2))
        t[0, 0] = t[-1, -1] = 1
        here = np.arange(k)
        t[1 + here, 1 + here], t[1 + here, 0], t[1 + here, 1 + k + here] = 1, -shift, shift
        return Products(t @ self.z @ t.T)

    def __sub__(self, other: "GapProducts") -> "GapProducts":
        return GapProducts(self.centre, self.z - other.z)


def medians_up_to(df: DataFrame, columns: list[str], bounds: list) -> np.ndarray:
    """(bounds, columns) exact medians of the rows up to each date; 0 for a column without any value."""
    sets = F.explode(F.array_compact(F.array(*[F.when(F.col("pred_date") <= F.lit(b), F.lit(i)) for i, b in enumerate(bounds)])))
    entries = F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]))
    long = df.select(sets.alias("upto"), *dict.fromkeys(columns)).select("upto", entries.alias("e")).select("upto", "e.*").where("value is not null")
    out = np.zeros((len(bounds), len(columns)))
    for r in quantiles(long, ["upto", "at"], "value", [0.5]).collect():
        out[r.upto, r["at"]] = r["quantile"]
    return out


def gap_products_up_to(df: DataFrame, features: list[str], target: Column, bounds: list, centre: np.ndarray) -> list[GapProducts]:
    """Products of the rows up to each of the rising dates: one pass by interval, then running sums."""
    interval = reduce(lambda later, i: F.when(F.col("pred_date") <= F.lit(bounds[i]), F.lit(i)).otherwise(later),
                      range(len(bounds) - 1, -1, -1), F.lit(None))
    present = [F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0)) for c, m in zip(features, centre)]
    columns = [F.lit(1.0), *present, *[F.col(c).isNull().cast("double") for c in features], target.cast("double")]
    return [GapProducts(centre, z) for z in grouped_products(df, columns, interval, len(bounds)).cumsum(0)]


def fit_ridge_folds(df: DataFrame, ends: list, features: list[str], target: Column, alphas: list[float],
                    fraction: float = 0.8) -> list[Ridge]:
    """``fit_ridge_grid`` on the rows up to each of the rising dates ``ends``, from one pass over all rows.

    Each set's inner cut is one more date, so the sets' early and late rows are differences of running sums.
    """
    cuts = [chronological_cut(df.where(F.col("pred_date") <= F.lit(end)), fraction).first().cut.date() for end in ends]
    bounds = sorted({*ends, *cuts})
    at = {b: i for i, b in enumerate(bounds)}
    medians = medians_up_to(df, features, bounds)
    upto = gap_products_up_to(df, features, target, bounds, medians[-1])
    models = []
    for end, cut in zip(ends, cuts):
        whole, early = upto[at[end]], upto[at[cut]]
        fit, check = early.filled(medians[at[cut]]), (whole - early).filled(medians[at[cut]])
        errors = [check.mean_squared_error(*fit.solve(a)) for a in alphas] if check.rows else [0.0] * (len(alphas) - 1) + [-1.0]
        alpha = alphas[int(np.argmin(errors))]
        weights, intercept = whole.filled(medians[at[end]]).solve(alpha)
        models.append(Ridge(Imputer(tuple(features), dict(zip(features, medians[at[end]].tolist()))), weights, intercept, alpha))
    return models
