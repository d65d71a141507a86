"""The published interface: predictions, actuals and statistics as CSV folders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import metrics as met, rolling
from ..operators.cross_section import session_mean
from ..operators.quality import ACTUAL_COLUMNS, PREDICTION_COLUMNS
from .staging import stage

PREDICTION_SCHEMA = ("pred_date date, target_date date, symbol string, pred_magnitude_pct double, "
                     "pred_direction int, conf_direction double, conf_magnitude double, split string")
ACTUAL_SCHEMA = ("pred_date date, target_date date, symbol string, actual_return_pct double, "
                 "actual_direction int, actual_magnitude_pct double, universe_mean_pct double")
STATISTICS_SCHEMA = "split string, scope string, metric string, value double, n_obs bigint"
DIGITS = {"pred_magnitude_pct": 4, "conf_direction": 6, "conf_magnitude": 6}


def clipped(c: str, lo: float, hi: float | None = None) -> Column:
    value = F.greatest(F.col(c), F.lit(lo))
    return value if hi is None else F.least(value, F.lit(hi))


def published_rows(scored: DataFrame) -> DataFrame:
    """Clipped and rounded forecasts with the recomputed outcome columns."""
    rows = scored.select(
        "pred_date", "target_date", "symbol", "split",
        F.bround(clipped("pred_magnitude_pct", 0.0), 4).alias("pred_magnitude_pct"),
        F.col("pred_direction").cast("int").alias("pred_direction"),
        F.bround(clipped("conf_direction", 0.5, 1.0), 6).alias("conf_direction"),
        F.bround(clipped("conf_magnitude", 0.0, 1.0), 6).alias("conf_magnitude"),
        "actual_return_pct",
        F.when(F.col("actual_return_pct") < 0, -1).otherwise(1).alias("actual_direction"),
        F.abs("actual_return_pct").alias("actual_magnitude_pct"))
    return session_mean(stage(rows, "published"), "actual_return_pct", "universe_mean_pct")


def fixed(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.col(c)).alias(c)


def prediction_text(rows: DataFrame) -> DataFrame:
    return rows.select(*[fixed(c, DIGITS[c]) if c in DIGITS else F.col(c) for c in PREDICTION_COLUMNS])


def actual_text(rows: DataFrame) -> DataFrame:
    numbers = {"actual_return_pct", "actual_magnitude_pct", "universe_mean_pct"}
    return rows.select(*[fixed(c, 10) if c in numbers else F.col(c) for c in ACTUAL_COLUMNS])


def read_outputs(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name, schema: spark.read.csv(f"{directory}/{name}", schema=schema, header=True)
    return read("predictions", PREDICTION_SCHEMA), read("actuals", ACTUAL_SCHEMA)


def read_statistics(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.csv(f"{directory}/statistics", schema=STATISTICS_SCHEMA, header=True)


def rescored(preds: DataFrame, actuals: DataFrame) -> DataFrame:
    """Statistics of the serialized values: exactly the rounded numbers that were published."""
    scored = preds.join(actuals, ["pred_date", "target_date", "symbol"])
    return met.statistics_table(rolling.vol_baseline(scored))


def write_outputs(scored: DataFrame, directory: str) -> None:
    """Write predictions and actuals in (pred_date, symbol) order, read them back and score them."""
    rows = stage(published_rows(scored), "published-rows")
    for name, text in (("predictions", prediction_text(rows)), ("actuals", actual_text(rows))):
        text.orderBy("pred_date", "symbol").write.mode("overwrite").csv(
            f"{directory}/{name}", header=True, dateFormat="yyyy-MM-dd")
    stats = rescored(*read_outputs(scored.sparkSession, directory))
    stats.orderBy("split", "scope", "metric").coalesce(1).write.mode("overwrite").csv(
        f"{directory}/statistics", header=True)
