"""Folders of per-symbol files: layouts side by side, file pruning, the file sink and the cache."""
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpanel.sources import bars as src

DAY = {"open": 10.5, "high": 11.0, "low": 10.0, "close": 10.75}


def put(folder, symbol, frame):
    folder.mkdir(exist_ok=True)
    frame.to_parquet(folder / f"{symbol}.parquet")


def days(*rows, **more):
    return pd.DataFrame([{"date": d, **DAY, "volume": v} for d, v in rows]).assign(**more)


def test_files_of_different_types_go_together(spark, tmp_path):
    put(tmp_path, "WHOLE", days((pd.Timestamp("2024-02-01"), 7), (pd.Timestamp("2024-02-02"), 8)))
    put(tmp_path, "REAL", days((pd.Timestamp("2024-02-01"), 7.5)))
    put(tmp_path, "TEXT", days(("2024-02-01", 9.0), ("not a day", 9.0)))
    put(tmp_path, "NAN", days((date(2024, 2, 1), float("nan"))))
    put(tmp_path, "UPPER", days((pd.Timestamp("2024-02-01"), 3)).rename(columns=str.upper))
    put(tmp_path, "EXTRA", days((pd.Timestamp("2024-02-01"), 4.0), note="x", symbol="other"))
    got = {(r.symbol, str(r.date)): r.volume for r in src.load_daily(spark, str(tmp_path), "2024-02-01", "2024-02-28").collect()}
    assert got == {("WHOLE", "2024-02-01"): 7.0, ("WHOLE", "2024-02-02"): 8.0, ("REAL", "2024-02-01"): 7.5,
                   ("TEXT", "2024-02-01"): 9.0, ("NAN", "2024-02-01"): None, ("UPPER", "2024-02-01"): 3.0,
                   ("EXTRA", "2024-02-01"): 4.0}


def test_only_the_files_of_the_symbols_are_opened(spark, tmp_path):
    put(tmp_path, "GOOD", days((pd.Timestamp("2024-02-01"), 7)))
    (tmp_path / "BROKEN.parquet").write_bytes(b"no parquet file")
    some = spark.createDataFrame([("GOOD",), ("ABSENT",)], "symbol string")
    assert [r.symbol for r in src.load_daily(spark, str(tmp_path), "2024-01-01", "2024-12-31", some).collect()] == ["GOOD"]
    assert {r.symbol for r in src.list_symbols(spark, str(tmp_path)).collect()} == {"GOOD", "BROKEN"}
    with pytest.raises(src.MissingBarsError):
        src.load_daily(spark, str(tmp_path), "2024-01-01", "2024-12-31", some.where("symbol = 'ABSENT'"))


def test_a_file_without_a_column_is_named(spark, tmp_path):
    put(tmp_path, "SHORT", days((pd.Timestamp("2024-02-01"), 7)).drop(columns="volume"))
    with pytest.raises(Exception, match="SHORT.parquet lacks volume"):
        src.load_daily(spark, str(tmp_path), "2024-01-01", "2024-12-31")


def test_date_bounds_reach_every_scan(spark, tmp_path):
    put(tmp_path, "A", days((pd.Timestamp("2024-02-01"), 7)).astype({"date": "datetime64[us]"}))
    put(tmp_path, "B", days((date(2024, 2, 1), 7.5)))
    plan = src.load_daily(spark, str(tmp_path), "2024-02-01", "2024-02-28")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(date") == 2, plan


def test_written_files_come_back(spark, tmp_path):
    """Names with signs that mean something in a URI; several batches a symbol; order kept."""
    names = ["M&M", "A#1", "B+C", "D E", "100%", "é"]
    df = spark.range(0, 30_000).select(
        F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 6 + 1).cast("int")).alias("symbol"),
        F.expr("timestamp_ntz'2024-02-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id div 6)").alias("timestamp"),
        *[(F.col("id") * 0.5).alias(c) for c in ("open", "high", "low", "close", "volume")])
    folder = str(tmp_path / "files")
    src.write_symbol_files(df, folder, ["timestamp"])
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == sorted(f"{n}.parquet" for n in names)
    assert pd.read_parquet(tmp_path / "files" / "M&M.parquet").timestamp.is_monotonic_increasing
    back = src.load_minutes(spark, folder)
    assert back.count() == 30_000 and back.exceptAll(df.select(back.columns)).isEmpty()
    src.write_symbol_files(df.where("symbol = 'D E'").limit(3), folder, ["timestamp"])
    assert src.load_minutes(spark, folder).groupBy("symbol").count().where("symbol = 'D E'").first()["count"] == 3


def test_a_bar_without_a_symbol_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(None, datetime(2024, 2, 1), 1.0)], "symbol string, timestamp timestamp_ntz, open double")
    with pytest.raises(Exception, match="without a symbol"):
        src.write_symbol_files(df, str(tmp_path / "files"), ["timestamp"])


def test_cache_keeps_symbols_as_texts_and_replaces_partitions(spark, tmp_path):
    path = str(tmp_path / "cache")
    build = lambda todo: todo.withColumn("x", F.lit(1.0))
    want = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    src.session_cache(spark, path, want("001", "2"), build)
    again = src.session_cache(spark, path, want("001", "2", "03"), build)
    assert sorted(r.symbol for r in again.collect()) == ["001", "03", "2"]
    # a second build of a symbol, as after a lost driver, leaves its rows once
    build(want("03")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)
    assert src.session_cache(spark, path, want("001", "2", "03"), build).count() == 3
