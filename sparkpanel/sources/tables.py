"""Panel inputs derived from the given tables: daily bars, minute bars and scored frames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import hash_fraction
from ..operators import calendar as cal, cross_section as cs, rolling
from .bars import bars_from_ticks
from .staging import stage

TRAIN_END, VALID_END, EMBARGO = "1999-03-31", "2000-06-30", 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: symbol = brand, price per unit, ship date."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        F.to_date("l_shipdate").alias("date"))
    return items.join(part, "l_partkey").select(
        "*", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"))


TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(trade_ticks(spark, sf_dir), ["symbol", "date"], TRADE_ORDER)


def event_ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """Events as ticks: price = value, volume = the JSON field k."""
    return table(spark, sf_dir, "events").select(
        F.col(symbol).cast("string").alias("symbol"), F.col("ts").alias("timestamp"), "event_id",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"))


def minute_bars(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    ticks = event_ticks(spark, sf_dir, symbol).withColumn("minute", F.date_trunc("minute", "timestamp").cast("timestamp_ntz"))
    bars = bars_from_ticks(ticks, ["symbol", "minute"], ["timestamp", "event_id"])
    return bars.withColumnRenamed("minute", "timestamp")


def event_daily_bars(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    ticks = event_ticks(spark, sf_dir, symbol).withColumn("date", F.to_date("timestamp"))
    return bars_from_ticks(ticks, ["symbol", "date"], ["timestamp", "event_id"])


def daily_with_calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    daily = stage(daily_bars(spark, sf_dir), "daily")
    return daily, stage(cal.session_calendar(daily), "calendar")


def target_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.overnight_targets(*daily_with_calendar(spark, sf_dir))


def history_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with split labels and lagged overnight history."""
    daily, calendar = daily_with_calendar(spark, sf_dir)
    bounds = cal.split_bounds(calendar, TRAIN_END, VALID_END, EMBARGO)
    panel = cal.label_splits(cal.overnight_targets(daily, calendar), bounds)
    return rolling.overnight_history(panel).select("*", *rolling.history_columns())


def short_minus_long() -> Column:
    """The five-move mean against the twenty-move mean; 0 where either is missing."""
    return F.coalesce(F.col("mag_mean_5") - F.col("mag_mean_20"), F.lit(0.0))


def scored_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged frame with the four forecasts and the realised outcome of every scorable row.

    The magnitude forecast is the trailing mean of 20 moves; where the symbol has too few of them the mean of 5, else
    the last move, else 0 takes its place, so that no scorable row is left out.  The direction follows the last moves of
    the market and the symbol, the confidences are hash-uniform; session_close is the day's average trade price.
    """
    forecasts = ["mag_mean_5", "mag_mean_20", "mag_mean_60", "mag_median_20", "mag_std_20"]
    panel = stage(history_panel(spark, sf_dir).select(
        "symbol", "pred_date", "target_date", "split", "close", "target_open", "target_close", "actual_return_pct",
        "actual_magnitude_pct", "actual_direction", "ret_lag_1", "history_count", *forecasts), "history")
    w = Window.orderBy("pred_date")
    market = stage(
        panel.groupBy("pred_date").agg(F.avg("actual_return_pct").alias("m"))
        .select("pred_date", F.lag("m").over(w).alias("mkt_on_lag_1")), "market")
    traded = trade_ticks(spark, sf_dir).groupBy("symbol", F.col("date").alias("pred_date")).agg(
        F.when(F.count(F.lit(1)) > 1, F.sum("l_extendedprice") / F.sum("l_quantity")).alias("session_close"))
    rows = cal.scorable_rows(panel)
    scored = rows.join(market, "pred_date", "left").join(traded, ["symbol", "pred_date"], "left").select(
        "pred_date", "target_date", "symbol", "split", "close", "target_open", "target_close", "session_close",
        "actual_return_pct", "actual_magnitude_pct", "actual_direction",
        F.coalesce("mag_mean_20", "mag_mean_5", F.abs("ret_lag_1"), F.lit(0.0)).alias("pred_magnitude_pct"),
        F.when(F.coalesce("mkt_on_lag_1", F.lit(0.0)) + F.coalesce("ret_lag_1", F.lit(0.0)) < 0, -1).otherwise(1)
        .alias("pred_direction"),
        (0.5 + 0.5 * hash_fraction(1, "symbol", "pred_date")).alias("conf_direction"),
        hash_fraction(2, "symbol", "pred_date").alias("conf_magnitude"),
        *forecasts, "history_count")
    scored = stage(rolling.vol_baseline(scored), "scored-rows")
    return stage(cs.session_mean(scored, "actual_return_pct", "universe_mean_pct"), "scored")
