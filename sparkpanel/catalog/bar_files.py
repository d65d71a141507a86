"""Bar files and the session cache: per-symbol files are written from the given tables and read back.

Files of one folder differ on purpose: integer volumes, dates and prices as texts, NaN prices, repeated rows.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import calendar as cal, intraday
from ..sources import bars, tables
from ..sources.staging import checkpoint_root, stage
from .registry import query, rounded
from .sql import DAILY, EVENT_BARS, SESSIONS, round_all, with_

START, END = "1994-02-01", "1997-10-31"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_mixed_daily(spark: SparkSession, sf: str) -> str:
    """Daily files in four layouts, by the number at the end of the brand: doubles; integer volumes and timestamps; NaN
    closes at small volumes and dates as texts; every row twice, the second with other prices."""
    folder = _folder(spark, "daily-files")
    daily = stage(tables.daily_bars(spark, sf).withColumn("layout", F.regexp_extract("symbol", "([0-9]+)$", 1).cast("int") % 4), "daily")
    of = lambda k: daily.where(F.col("layout") == k).drop("layout")
    whole = of(1).withColumns({"volume": F.col("volume").cast("long"), "date": F.col("date").cast("timestamp_ntz")})
    gaps = of(2).withColumns({"close": F.when(F.col("volume") < 40, F.lit(float("nan"))).otherwise(F.col("close")),
                              "date": F.col("date").cast("string")})
    twice = of(3).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("open", F.col("open") + F.col("copy"))
    bars.write_symbol_files(of(0), folder, ["date"])
    bars.write_symbol_files(whole, folder, ["date"])
    bars.write_symbol_files(gaps, folder, ["date"])
    bars.write_symbol_files(twice, folder, ["date", "copy"])
    return folder


@query("daily_file_scan", with_(DAILY, f"""
SELECT symbol, date, open, high, low, volume,
       CASE WHEN CAST(regexp_extract(symbol, '[0-9]+$') AS INTEGER) % 4 <> 2 OR volume >= 40 THEN close END AS close
FROM daily WHERE date BETWEEN DATE '{START}' AND DATE '{END}'"""))
def daily_file_scan(spark, sf):
    """Daily bars of a date range out of files in four layouts; the first of two rows for a date stays."""
    return bars.load_daily(spark, write_mixed_daily(spark, sf), START, END)


@query("daily_file_keys", with_(DAILY, f"""
SELECT symbol, count(*) AS n_rows, count(DISTINCT date) AS dates FROM daily
WHERE date BETWEEN DATE '{START}' AND DATE '{END}' AND symbol LIKE '%3' GROUP BY symbol"""))
def daily_file_keys(spark, sf):
    """Rows and dates of the symbols that end in 3: only their files are opened, and each key is there once."""
    folder = write_mixed_daily(spark, sf)
    some = bars.list_symbols(spark, folder).where(F.col("symbol").endswith("3"))
    daily = cal.unique_rows(bars.load_daily(spark, folder, START, END, some), ["symbol", "date"])
    return daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("dates"))


def write_mixed_minutes(spark: SparkSession, sf: str) -> str:
    """Minute files in two layouts, by the length of the symbol: doubles; opens as texts, those of the minutes divisible by
    7 no number, and every row twice, the first with another close."""
    folder = _folder(spark, "minute-files")
    minutes = stage(tables.minute_bars(spark, sf), "minutes")
    odd = F.length("symbol") % 2 == 1
    texts = minutes.where(odd).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "open": F.when(F.minute("timestamp") % 7 == 0, "none").otherwise(F.col("open").cast("string")),
        "close": F.when(F.col("copy") == 0, F.col("close") + 1).otherwise(F.col("close"))})
    bars.write_symbol_files(minutes.where(~odd), folder, ["timestamp"])
    bars.write_symbol_files(texts, folder, ["timestamp", "copy"])
    return folder


@query("minute_file_scan", with_(EVENT_BARS, """
SELECT * FROM minutes WHERE length(symbol) % 2 = 0 OR extract('minute' FROM timestamp) % 7 <> 0""", symbol="event_type"))
def minute_file_scan(spark, sf):
    """Minute bars out of files in two layouts; rows without a price go, the last of two rows for a minute stays."""
    return bars.load_minutes(spark, write_mixed_minutes(spark, sf))


CACHED = "session_open session_high session_low session_close total_volume rv_full_pct minute_coverage"


@query("session_cache_fill", with_(SESSIONS, f"SELECT symbol, pred_date, {round_all(CACHED)} FROM sessions", symbol="event_type"))
def session_cache_fill(spark, sf):
    """Session features out of a cache that is filled in two steps: some symbols first, then those it lacks."""
    folder, cache = _folder(spark, "minute-files"), _folder(spark, "session-cache")
    bars.write_symbol_files(tables.minute_bars(spark, sf), folder, ["timestamp"])
    symbols = bars.list_symbols(spark, folder)

    def build(todo: DataFrame) -> DataFrame:
        return intraday.session_features(intraday.five_minute_bars(bars.load_minutes(spark, folder, todo)))

    bars.session_cache(spark, cache, symbols.where("symbol < 'l'"), build)
    return rounded(bars.session_cache(spark, cache, symbols, build).select("symbol", "pred_date", *CACHED.split()))
