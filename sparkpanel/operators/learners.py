"""Spark ML learners behind one shape: fit(train) returns a function that adds a column.

MLlib learners do not accept missing values, so every one is preceded by the median
imputer with indicators, fitted on its own training rows.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage
from .linear import Imputer, fit_imputer, fit_scaler

Predictor = Callable[[DataFrame, str], DataFrame]
PROB_CLIP = 1e-6
#: A leaf's quantiles have a rank error of at most one part in so many.
ACCURACY = 10_000
#: Numbers a task of a tree learner goes through at each level; below, a round is mostly the start of its tasks.
TASK_CELLS = 4_000_000


def _assembled(df: DataFrame, columns: list[Column], names: list[str]) -> DataFrame:
    wide = df.select("*", *[c.alias(f"_x{i}") for i, c in enumerate(columns)])
    inputs = [f"_x{i}" for i in range(len(names))]
    return VectorAssembler(inputCols=inputs, outputCol="_features").transform(wide).drop(*inputs)


def _result(model_out: DataFrame, df: DataFrame, value: Column, out: str) -> DataFrame:
    return model_out.select(*[c for c in df.columns if c != out], value.alias(out))


def _tree_features(train: DataFrame, imputer: Imputer, by_symbol: bool):
    """Assembler for trees: imputed columns plus the symbol as a categorical input.

    The indexer's nominal attribute travels with the column, so the learners see the
    symbol as a category; an unseen symbol gets a category of its own.
    """
    columns, names = imputer.columns(), list(imputer.names)
    if not by_symbol:
        return lambda df: _assembled(df, columns, names), None
    index = StringIndexer(inputCol="symbol", outputCol="_symbol", handleInvalid="keep").fit(train)

    def assemble(df: DataFrame) -> DataFrame:
        with_symbol = index.transform(df)
        return _assembled(with_symbol, [*columns, F.col("_symbol")], [*names, "symbol"]).drop("_symbol")
    return assemble, len(index.labels) + 1


def _in_whole_tasks(data: DataFrame, width: int) -> DataFrame:
    """Staged rows in as many tasks as ``TASK_CELLS`` asks for, at most those of the scan."""
    return data.coalesce(max(1, math.ceil(data.count() * width / TASK_CELLS)))


def fit_boosted_trees(train: DataFrame, features: list[str], target: Column, by_symbol: bool = True,
                      max_iter: int = 20, depth: int = 5, step: float = 0.1, min_leaf: int = 20,
                      subsample: float = 0.8, seed: int = 42) -> Predictor:
    """Squared-loss boosted trees."""
    imputer = fit_imputer(train, features, indicators=True)
    assemble, categories = _tree_features(train, imputer, by_symbol)
    data = _in_whole_tasks(stage(assemble(train.withColumn("_y", target)).select("_features", "_y"), "tree-train"), len(imputer.names))
    gbt = GBTRegressor(featuresCol="_features", labelCol="_y", predictionCol="_p", maxIter=max_iter, maxDepth=depth,
                       stepSize=step, minInstancesPerNode=min_leaf, subsamplingRate=subsample, seed=seed,
                       maxBins=max(32, categories or 0))
    model = gbt.fit(data)

    def predict(df: DataFrame, out: str) -> DataFrame:
        return _result(model.transform(assemble(df)), df, F.col("_p"), out)
    return predict


def fit_quantile_forest(train: DataFrame, features: list[str], target: Column, levels: list[float],
                        row_keys: list[str], by_symbol: bool = True, trees: int = 10, depth: int = 5,
                        min_leaf: int = 20, seed: int = 42, accuracy: int = ACCURACY) -> Predictor:
    """Conditional quantiles: quantiles of the training outcome in every leaf, averaged over trees.

    A leaf's quantiles come from a summary that tasks build of their own rows and Spark merges, so what is shuffled grows with
    leaves and tasks, not with rows x trees.  A quantile is an outcome of the leaf whose rank is within n / ``accuracy`` of
    the wanted one.  The leaf table, trees x 2^depth x levels numbers, is set by the parameters; it goes along as
    one row, so a prediction is an expression over the row's leaves.
    """
    assemble, categories = _tree_features(train, fit_imputer(train, features, indicators=True), by_symbol)
    data = stage(assemble(train.withColumn("_y", target)).select("_features", "_y"), "forest-train")
    model = RandomForestRegressor(
        featuresCol="_features", labelCol="_y", leafCol="_leaf", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed, maxBins=max(32, categories or 0)).fit(data)
    table = stage(leaf_table(model.transform(data).select(vector_to_array("_leaf").alias("_leaf"), "_y"), levels, accuracy), "leaf-quantiles")

    def predict(df: DataFrame, out: str) -> DataFrame:
        scored = model.transform(assemble(df)).withColumn("_leaves", vector_to_array("_leaf"))
        hit = F.transform("_leaves", lambda leaf, tree: F.try_element_at(
            F.try_element_at("_table", tree), leaf.cast("int")))
        known = F.filter(hit, lambda q: q.isNotNull())
        mean = F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda i: F.aggregate(
            known, F.lit(0.0), lambda total, q: total + F.get(q, i), lambda total: total / F.size(known)))
        return _result(scored.crossJoin(F.broadcast(table)), df, mean, out)
    return predict


def leaf_table(leaves: DataFrame, levels: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """One row with ``_table``, a map from tree to a map from leaf to its quantiles; ``leaves`` has (_leaf, _y)."""
    placed = leaves.select("_y", F.posexplode("_leaf").alias("tree", "leaf")).where("_y is not null")
    per_leaf = placed.groupBy("tree", F.col("leaf").cast("int").alias("leaf")).agg(
        F.percentile_approx("_y", [float(p) for p in levels], accuracy).alias("q"))
    per_tree = per_leaf.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "q"))).alias("at"))
    return per_tree.agg(F.map_from_entries(F.collect_list(F.struct("tree", "at"))).alias("_table"))


def fit_logistic(train: DataFrame, features: list[str], label: str, c: float = 1.0, max_iter: int = 200) -> Predictor:
    """L2 logistic regression on standardised inputs; ``c`` is the inverse penalty of the summed loss."""
    scaler = fit_scaler(train, fit_imputer(train, features, indicators=True))
    n = train.count()
    data = _assembled(train, scaler.columns(), scaler.imputer.names).select("_features", F.col(label).alias("_y"))
    model = LogisticRegression(
        featuresCol="_features", labelCol="_y", probabilityCol="_prob", rawPredictionCol="_raw",
        predictionCol="_class", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter).fit(data)

    def predict(df: DataFrame, out: str) -> DataFrame:
        scored = model.transform(_assembled(df, scaler.columns(), scaler.imputer.names))
        p = vector_to_array("_prob")[1]
        return _result(scored, df, F.least(F.greatest(p, F.lit(PROB_CLIP)), F.lit(1 - PROB_CLIP)), out)
    return predict
