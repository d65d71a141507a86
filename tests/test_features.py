"""Rolling features, leakage, intraday aggregation and the feature registry."""
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import cross_section as cs, intraday, rolling
from sparkpanel.plans.panel import build_panel
from sparkpanel.sources import bars as src
from sparkpanel.streaming.five_minute import stream_five_minute_bars


def history(spark, values, symbol="A", name="value"):
    first = date(2024, 1, 1)
    rows = [(symbol, first + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, pred_date date, {name} double")


def column(df, expr):
    return [r.x for r in df.select("pred_date", expr.alias("x")).orderBy("pred_date").collect()]


def test_trailing_statistic_is_strictly_shifted(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    got = column(history(spark, values), rolling.trailing("value", 3, "mean", 1))
    assert got[0] is None and got[1] == 1.0 and got[3] == 2.0
    values[3] = 10_000.0
    assert column(history(spark, values), rolling.trailing("value", 3, "mean", 1))[3] == 2.0


def test_rolling_operators_match_pandas(spark):
    rng = np.random.default_rng(3)
    s = pd.Series(np.round(rng.normal(size=150), 1))
    s[rng.random(150) < 0.2] = np.nan
    df = history(spark, [None if np.isnan(v) else float(v) for v in s])
    lagged = s.shift(1)
    want = {
        "std": (rolling.trailing("value", 20, "std", 10), lagged.rolling(20, min_periods=10).std()),
        "median": (rolling.trailing("value", 20, "median", 10), lagged.rolling(20, min_periods=10).median()),
        "rank": (rolling.trailing_pct_rank("value", 60, 20), lagged.rolling(60, min_periods=20).rank(pct=True)),
        "share": (rolling.trailing_up_share("value", 20, 10), lagged.ge(0).rolling(20, min_periods=10).mean()),
    }
    for name, (expr, expected) in want.items():
        got = pd.Series(column(df, expr), dtype=float)
        assert np.allclose(got, expected, equal_nan=True), name
    ewm = rolling.trailing_ewm(df, "value", "x").orderBy("pred_date").toPandas()["x"].astype(float)
    assert np.allclose(ewm, lagged.ewm(halflife=20, adjust=False, min_periods=10).mean(), equal_nan=True)
    # short half-lives: the running product restarts many times, also over gaps that leave nothing of the past
    for halflife, lost in ((0.4, 0.2), (0.1, 0.7), (3, 0.0)):
        lossy = s.where(rng.random(150) >= lost)
        want = lossy.shift(1).ewm(halflife=halflife, adjust=False, min_periods=2).mean()
        df = history(spark, [None if np.isnan(v) else float(v) for v in lossy])
        got = rolling.trailing_ewm(df, "value", "x", halflife, 2).orderBy("pred_date").toPandas()["x"].astype(float)
        assert np.allclose(got, want, equal_nan=True, rtol=1e-9, atol=1e-12), halflife
    df = history(spark, [None if np.isnan(v) else float(v) for v in s])
    streak = rolling.sign_streak(df, "value", "x").orderBy("pred_date").toPandas()["x"]
    up, run, expected = lagged.ge(0).tolist(), 0, []
    for i, u in enumerate(up):
        run = run + 1 if i and u == up[i - 1] else 1
        expected.append(run)
    assert streak.tolist() == expected


def test_vol_baseline_excludes_the_current_row(spark):
    df = rolling.vol_baseline(history(spark, [float(v) for v in range(25)], name="actual_magnitude_pct"))
    got = [r.vol_baseline_20 for r in df.orderBy("pred_date").collect()]
    assert got[19] is None and got[20] == pytest.approx(np.mean(range(20)))


def daily(spark, n_symbols=6, n_days=90, bump=None):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n_symbols):
        close = 100.0
        for d in range(n_days):
            open_ = close * (1 + rng.normal(0, 0.01))
            close = open_ * (1 + rng.normal(0, 0.01))
            shift = 1.5 if bump is not None and d >= bump else 1.0
            rows.append((f"S{i}", date(2024, 1, 1) + timedelta(days=d), open_ * shift, max(open_, close) * shift * 1.01,
                         min(open_, close) * shift * 0.99, close * shift, float(rng.integers(100, 1000))))
    return spark.createDataFrame(
        rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_features_never_see_later_rows(spark):
    """Prices from day 60 on change; features up to day 58 stay (day 59 keeps its features but not its target)."""
    run = lambda b: build_panel(daily(spark, bump=b), None, "2024-02-10", "2024-03-05", mode="final-test").panel
    cut = date(2024, 1, 1) + timedelta(days=59)
    cols = [c for c in cs.feature_columns(run(None))]
    assert len(cols) == 127
    pick = lambda p: p.where(F.col("pred_date") < F.lit(cut)).select("symbol", "pred_date", *cols).orderBy(
        "symbol", "pred_date").toPandas()
    before, after = pick(run(None)), pick(run(60))
    assert len(before) > 100
    pd.testing.assert_frame_equal(before, after)


def test_feature_registry_excludes_labels(spark):
    df = spark.createDataFrame(
        [(1.0, 0.1, 0.1, 2.0, 2.0, 1, 102.0, 103.0, "A", "train")],
        "safe double, bench_gap_pct double, mkt_bench_gap double, actual_return_pct double, actual_magnitude_pct double, "
        "actual_direction int, target_open double, target_close double, symbol string, split string")
    assert cs.feature_columns(df) == ["bench_gap_pct", "mkt_bench_gap", "safe"]
    assert cs.feature_columns(df, include_benchmark=False) == ["safe"]
    assert set(cs.BENCHMARK_FEATURES) >= {"bench_gap_pct", "mkt_bench_gap"}


def minute_rows(skip=(2,)):
    start = datetime(2024, 1, 2, 9, 15)
    return [(start + timedelta(minutes=i), 100 + i * 0.01, 100.02 + i * 0.01, 99.98 + i * 0.01, 100 + i * 0.01, 1.0)
            for i in range(375) if i not in skip]


MINUTE_SCHEMA = "timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


def test_minute_aggregation_is_anchored_and_keeps_incomplete_buckets(spark, tmp_path):
    rows = minute_rows() + [(datetime(2024, 1, 2, 9, 14), 1.0, 1.0, 1.0, 1.0, 1.0),
                            (datetime(2024, 1, 2, 15, 30), 9.0, 9.0, 9.0, 9.0, 9.0)]
    spark.createDataFrame(rows, MINUTE_SCHEMA).coalesce(1).toPandas().to_parquet(tmp_path / "SYNTH.parquet")
    bars = src.load_minutes(spark, str(tmp_path))
    row = intraday.session_features(intraday.five_minute_bars(bars)).first()
    price = lambda i: 100 + i * 0.01
    assert row.symbol == "SYNTH" and row.minute_bar_count == 374 and row.five_min_bar_count == 75
    assert row.incomplete_5m_buckets == 1
    assert row.session_open == pytest.approx(price(0)) and row.session_close == pytest.approx(price(374))
    assert row.return_final_15_pct == pytest.approx((price(374) / price(359) - 1) * 100)


def test_daily_scan_keeps_the_first_and_minute_scan_the_last_copy(spark, tmp_path):
    (tmp_path / "d").mkdir(), (tmp_path / "m").mkdir()
    day = pd.DataFrame({"Date": pd.to_datetime(["2024-01-03", "2024-01-02", "2024-01-03", "2024-02-01"]),
                        "Open": [1.0, 2, 3, 4], "High": [1.0, 2, 3, 4], "Low": [1.0, 2, 3, 4], "Close": [1.0, 2, 3, 4],
                        "Volume": [1, 2, 3, 4]})
    day.to_parquet(tmp_path / "d" / "AAA.parquet")
    got = src.load_daily(spark, str(tmp_path / "d"), "2024-01-01", "2024-01-31").orderBy("date").collect()
    assert [(r.symbol, r.date, r.open) for r in got] == [("AAA", date(2024, 1, 2), 2.0), ("AAA", date(2024, 1, 3), 1.0)]
    minute = pd.DataFrame({"timestamp": pd.to_datetime(["2024-01-02 09:15"] * 2 + ["2024-01-02 09:16"]),
                           "open": ["1", "2", "x"], "high": [1.0, 2, 3], "low": [1.0, 2, 3], "close": [1.0, 2, 3],
                           "volume": [None, 5.0, 6.0]})
    minute.to_parquet(tmp_path / "m" / "AAA.parquet")
    got = src.load_minutes(spark, str(tmp_path / "m")).collect()
    assert [(r.open, r.volume) for r in got] == [(2.0, 5.0)]
    assert {r.symbol for r in src.list_symbols(spark, str(tmp_path / "m")).collect()} == {"AAA"}
    want = spark.createDataFrame([("AAA",), ("BBB",)], "symbol string")
    with pytest.raises(src.MissingBarsError, match="BBB"):
        src.require_minutes(want, src.list_symbols(spark, str(tmp_path / "m")))


def test_session_cache_builds_only_missing_symbols(spark, tmp_path):
    built = []

    def build(symbols):
        names = sorted(r.symbol for r in symbols.collect())
        built.append(names)
        return spark.createDataFrame([(n, 1.0) for n in names], "symbol string, v double")

    expect = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    path = str(tmp_path / "cache")
    assert src.session_cache(spark, path, expect("A", "B"), build).count() == 2
    assert src.session_cache(spark, path, expect("A", "B"), build).count() == 2
    assert src.session_cache(spark, path, expect("A", "B", "C"), build).count() == 3
    assert built == [["A", "B"], ["C"]]
    src.session_cache(spark, path, expect("A"), build, rebuild=True)
    assert built[-1] == ["A"]


def test_streaming_bars_equal_batch_bars(spark, tmp_path):
    rows = [("S", *r) for r in minute_rows()]
    df = spark.createDataFrame(rows, "symbol string, " + MINUTE_SCHEMA.replace("timestamp_ntz", "timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (stream_five_minute_bars(stream, "1 minute").writeStream.outputMode("complete").format("memory")
         .queryName("five").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    cols = ["symbol", "bucket", "open", "high", "low", "close", "volume", "minute_count"]
    got = {tuple(r) for r in spark.table("five").select(*cols).collect()}
    want = {tuple(r) for r in intraday.five_minute_bars(df).select(*cols).collect()}
    assert got == want
