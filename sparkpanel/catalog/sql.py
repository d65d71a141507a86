"""SQL building blocks: the common table expressions shared by the oracle queries."""
from __future__ import annotations

DAILY = """
trades AS (
  SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS date, l.l_extendedprice / l.l_quantity AS price,
         l.l_quantity AS volume, l.l_extendedprice, l.l_quantity,
         row(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity) AS k
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
daily AS (
  SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, sum(volume) AS volume
  FROM trades GROUP BY symbol, date),
calendar AS (
  SELECT date AS session, row_number() OVER (ORDER BY date) - 1 AS session_idx,
         lead(date) OVER (ORDER BY date) AS next_session
  FROM (SELECT DISTINCT date FROM daily))"""

TARGETS = DAILY + """,
targets AS (
  SELECT d.symbol, d.date AS pred_date, c.next_session AS target_date, d.open, d.high, d.low, d.close, d.volume,
         n.open AS target_open, n.close AS target_close,
         CASE WHEN d.close > 0 AND n.open > 0 THEN (n.open / d.close - 1.0) * 100.0 END AS actual_return_pct
  FROM daily d JOIN calendar c ON d.date = c.session
  LEFT JOIN daily n ON n.symbol = d.symbol AND n.date = c.next_session),
panel0 AS (
  SELECT *, abs(actual_return_pct) AS actual_magnitude_pct,
         CASE WHEN actual_return_pct < 0 THEN -1 WHEN actual_return_pct IS NOT NULL THEN 1 END AS actual_direction
  FROM targets)"""

SPLITS = TARGETS + """,
edges AS (
  SELECT max(session_idx) FILTER (session <= DATE '1999-03-31') AS tr,
         max(session_idx) FILTER (session <= DATE '2000-06-30') AS va FROM calendar),
bounds AS (
  SELECT max(session) FILTER (session_idx = tr) AS train_end,
         max(session) FILTER (session_idx = tr + 6) AS valid_start,
         max(session) FILTER (session_idx = va) AS valid_end,
         max(session) FILTER (session_idx = va + 6) AS test_start
  FROM calendar, edges),
panel AS (
  SELECT p.*, CASE WHEN pred_date <= train_end THEN 'train'
                   WHEN pred_date BETWEEN valid_start AND valid_end THEN 'valid'
                   WHEN pred_date >= test_start THEN 'test' END AS split,
         row_number() OVER (PARTITION BY symbol ORDER BY pred_date) - 1 AS history_count
  FROM panel0 p, bounds)"""


def trailing(c: str, n: int, stat: str, least: int, part: str = "PARTITION BY symbol ") -> str:
    """Statistic of the n rows before the current one, null below ``least`` values."""
    over = f"OVER ({part}ORDER BY pred_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) {over} >= {least} THEN {stat.format(c)} {over} END"


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER (PARTITION BY symbol ORDER BY pred_date)"


HISTORY = SPLITS + f""",
hist AS (
  SELECT *, {lag('actual_return_pct')} AS ret_lag_1,
    {trailing('actual_magnitude_pct', 5, 'avg({})', 3)} AS mag_mean_5,
    {trailing('actual_magnitude_pct', 20, 'avg({})', 10)} AS mag_mean_20,
    {trailing('actual_magnitude_pct', 60, 'avg({})', 30)} AS mag_mean_60,
    {trailing('actual_magnitude_pct', 20, 'stddev_samp({})', 10)} AS mag_std_20,
    {trailing('actual_magnitude_pct', 20, 'quantile_cont({}, 0.5)', 10)} AS mag_median_20
  FROM panel)"""


def fraction(seed: int, *keys: str) -> str:
    """Uniform [0, 1) number from the first 32 bits of an md5."""
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8)) AS BIGINT) / 4294967296.0)"


def bucket(seed: int | str, n: str, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8)) AS BIGINT) % ({n}))"


SCORED = HISTORY + f""",
market_on AS (
  SELECT pred_date, lag(m) OVER (ORDER BY pred_date) AS mkt_on_lag_1
  FROM (SELECT pred_date, avg(actual_return_pct) AS m FROM panel GROUP BY pred_date)),
traded AS (
  SELECT symbol, date AS pred_date,
         CASE WHEN count(*) > 1 THEN sum(l_extendedprice) / sum(l_quantity) END AS session_close
  FROM trades GROUP BY symbol, date),
scored0 AS (
  SELECT h.pred_date, h.target_date, h.symbol, h.split, h.close, h.target_open, h.target_close, t.session_close,
         h.actual_return_pct, h.actual_magnitude_pct, h.actual_direction, 
         coalesce(h.mag_mean_20, h.mag_mean_5, abs(h.ret_lag_1), 0) AS pred_magnitude_pct,
         CASE WHEN coalesce(m.mkt_on_lag_1, 0) + coalesce(h.ret_lag_1, 0) < 0 THEN -1 ELSE 1 END AS pred_direction,
         0.5 + 0.5 * {fraction(1, 'h.symbol', 'h.pred_date')} AS conf_direction,
         {fraction(2, 'h.symbol', 'h.pred_date')} AS conf_magnitude,
         h.mag_mean_5, h.mag_mean_20, h.mag_mean_60, h.mag_median_20, h.mag_std_20, h.history_count
  FROM hist h LEFT JOIN market_on m ON h.pred_date = m.pred_date
  LEFT JOIN traded t ON t.symbol = h.symbol AND t.pred_date = h.pred_date
  WHERE h.actual_return_pct IS NOT NULL AND h.split IS NOT NULL AND h.history_count >= 20),
scored AS (
  SELECT *, {trailing('actual_magnitude_pct', 20, 'avg({})', 20)} AS vol_baseline_20,
         avg(actual_return_pct) OVER (PARTITION BY pred_date) AS universe_mean_pct
  FROM scored0)"""

# ---- intraday bars of the events table
EVENT_BARS = """
ticks AS (
  SELECT {symbol}::VARCHAR AS symbol, ts, event_id, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events),
minutes AS (
  SELECT symbol, date_trunc('minute', ts) AS timestamp, arg_min(price, row(ts, event_id)) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, sum(volume) AS volume
  FROM ticks GROUP BY ALL),
five AS (
  SELECT symbol, CAST(timestamp AS DATE) AS date,
         CAST((hour(timestamp) * 60 + minute(timestamp) - 555) // 5 AS SMALLINT) AS bucket,
         arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close,
         coalesce(sum(volume), 0) AS volume, count(*) AS minute_count
  FROM minutes WHERE hour(timestamp) * 60 + minute(timestamp) BETWEEN 555 AND 929 GROUP BY ALL)"""

SESSIONS = EVENT_BARS + """,
steps AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol, date ORDER BY bucket), open) AS prev_close FROM five),
rets AS (
  SELECT *, CASE WHEN close > 0 AND prev_close > 0 THEN ln(close / prev_close) END AS log_ret,
         abs(close - prev_close) AS abs_path, close * volume AS dv FROM steps),
agg AS (
  SELECT symbol, date AS pred_date,
    arg_min(open, bucket) AS session_open, max(high) AS session_high, min(low) AS session_low,
    arg_max(close, bucket) AS session_close, CAST(sum(minute_count) AS BIGINT) AS minute_bar_count,
    count(*) AS five_min_bar_count, sum(volume) AS total_volume, sum(abs_path) AS path_length,
    max(log_ret) * 100.0 AS max_5m_return, min(log_ret) * 100.0 AS min_5m_return,
    max(abs(log_ret)) * 100.0 AS max_abs_5m_return,
    avg(CASE WHEN log_ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_5m_share,
    sum(CASE WHEN log_ret > 0 THEN log_ret * log_ret ELSE 0.0 END) AS pos,
    sum(CASE WHEN log_ret < 0 THEN log_ret * log_ret ELSE 0.0 END) AS neg,
    sum(dv) AS dollar_volume,
    sqrt(sum(log_ret * log_ret)) * 100.0 AS rv_full_pct,
    sqrt(sum(log_ret * log_ret) FILTER (bucket < 39)) * 100.0 AS rv_morning_pct,
    sqrt(sum(log_ret * log_ret) FILTER (bucket >= 39)) * 100.0 AS rv_afternoon_pct,
    sqrt(sum(log_ret * log_ret) FILTER (bucket >= 63)) * 100.0 AS rv_final_60_pct,
    sqrt(sum(log_ret * log_ret) FILTER (bucket >= 69)) * 100.0 AS rv_final_30_pct,
    sum(volume) FILTER (bucket < 12) AS v_first, sum(volume) FILTER (bucket >= 63) AS v60,
    sum(volume) FILTER (bucket >= 69) AS v30, sum(volume) FILTER (bucket >= 72) AS v15, max(volume) AS vmax,
    max(close) FILTER (bucket = 71) AS c15, max(close) FILTER (bucket = 68) AS c30,
    max(close) FILTER (bucket = 62) AS c60, max(close) FILTER (bucket = 56) AS c1400,
    max(close) FILTER (bucket = 11) AS cfirst,
    arg_max(bucket, row(high, -bucket)) / 74.0 AS high_time_fraction,
    arg_min(bucket, row(low, bucket)) / 74.0 AS low_time_fraction,
    CASE WHEN count(*) FILTER (close > 0) > 1
      THEN regr_slope(CASE WHEN close > 0 THEN ln(close) END, bucket / 74.0) END * 100.0 AS trend_slope_pct,
    count(*) FILTER (minute_count < 5) AS incomplete_5m_buckets
  FROM rets GROUP BY symbol, date),
sessions AS (
  SELECT *, dollar_volume / nullif(total_volume, 0) AS vwap,
    (session_close / nullif(dollar_volume / nullif(total_volume, 0), 0) - 1.0) * 100.0 AS close_vs_vwap_pct,
    abs(session_close - session_open) / nullif(path_length, 0) AS path_efficiency,
    sqrt(pos) * 100.0 AS rsv_positive, sqrt(neg) * 100.0 AS rsv_negative,
    (pos - neg) / nullif(pos + neg, 0) AS semivariance_imbalance,
    v_first / nullif(total_volume, 0) AS first_hour_volume_share,
    v60 / nullif(total_volume, 0) AS final_60_volume_share,
    v30 / nullif(total_volume, 0) AS final_30_volume_share,
    v15 / nullif(total_volume, 0) AS final_15_volume_share,
    vmax / nullif(total_volume, 0) AS max_5m_volume_share,
    (session_close / c15 - 1.0) * 100.0 AS return_final_15_pct,
    (session_close / c30 - 1.0) * 100.0 AS return_final_30_pct,
    (session_close / c60 - 1.0) * 100.0 AS return_final_60_pct,
    (session_close / c1400 - 1.0) * 100.0 AS return_1400_close_pct,
    (cfirst / session_open - 1.0) * 100.0 AS return_first_hour_pct,
    minute_bar_count / 375.0 AS minute_coverage
  FROM agg)"""


def with_(ctes: str, select: str, **fmt: str) -> str:
    return f"WITH {ctes.format(**fmt) if fmt else ctes}\n{select}"


def round_all(cols: str, digits: int = 6) -> str:
    """'a b c' -> 'round(a, 6) + 0.0 AS a, ...'; the sum turns a negative zero into zero, as Spark's round does."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols.split())


# ---- the research feature panel: scorable rows before the test block
FACTS_PANEL = TARGETS.replace(
    "targets AS (", """cutoff AS (
  SELECT max(session) FILTER (session_idx = (SELECT max(session_idx) FILTER (session <= DATE '2000-06-30') FROM calendar) + 6)
    AS test_start FROM calendar),
early AS (SELECT daily.* FROM daily, cutoff WHERE date < test_start),
targets AS (""").replace("FROM daily d JOIN calendar", "FROM early d JOIN calendar").replace(
    "LEFT JOIN daily n", "LEFT JOIN early n") + SPLITS[len(TARGETS):] + f""",
lagged AS (
  SELECT *, {lag('close')} AS prev_close, {lag('close', 2)} AS c2, {lag('close', 5)} AS c5, {lag('close', 20)} AS c20,
    {trailing('high', 20, 'max({})', 10)} AS hi20, {trailing('low', 20, 'min({})', 10)} AS lo20,
    {lag('actual_magnitude_pct')} AS mag_lag_1, {lag('actual_return_pct')} AS ret_lag_1,
    {trailing('actual_magnitude_pct', 5, 'avg({})', 3)} AS mag_mean_5,
    {trailing('actual_magnitude_pct', 20, 'avg({})', 10)} AS mag_mean_20,
    {trailing('actual_magnitude_pct', 60, 'avg({})', 30)} AS mag_mean_60,
    {trailing('actual_magnitude_pct', 20, 'stddev_samp({})', 10)} AS mag_std_20,
    {trailing('actual_magnitude_pct', 20, 'quantile_cont({}, 0.5)', 10)} AS mag_median_20
  FROM panel),
facts AS (
  SELECT *, (close / prev_close - 1.0) * 100.0 AS ret_cc_pct, (close / open - 1.0) * 100.0 AS ret_oc_pct,
    (open / prev_close - 1.0) * 100.0 AS gap_into_t_pct, (high - low) / prev_close * 100.0 AS range_pct,
    (close - low) / nullif(high - low, 0) AS close_location, (close / c2 - 1.0) * 100.0 AS ret_2d_pct,
    (close / c5 - 1.0) * 100.0 AS ret_5d_pct, (close / c20 - 1.0) * 100.0 AS ret_20d_pct,
    (close / hi20 - 1.0) * 100.0 AS dist_20d_high_pct, (close / lo20 - 1.0) * 100.0 AS dist_20d_low_pct,
    sqrt(pow(ln(high / low), 2) / (4 * ln(2))) * 100.0 AS parkinson,
    sqrt(greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0)) * 100.0 AS garman_klass
  FROM lagged),
market AS (
  SELECT *, lag(mkt_on) OVER (ORDER BY pred_date) AS mkt_on_lag_1 FROM (
    SELECT pred_date, avg(ret_oc_pct) AS mkt_ret_oc, avg(ret_cc_pct) AS mkt_ret_cc,
      avg(CASE WHEN ret_oc_pct > 0 THEN 1.0 ELSE 0.0 END) AS mkt_breadth_up, avg(close_location) AS mkt_near_high,
      avg(actual_return_pct) AS mkt_on FROM facts GROUP BY pred_date)),
final_panel AS (
  SELECT * FROM (
    SELECT f.*, m.* EXCLUDE (pred_date), f.ret_oc_pct - m.mkt_ret_oc AS stock_minus_mkt_oc,
      CASE WHEN range_pct IS NOT NULL THEN (rank() OVER (PARTITION BY f.pred_date ORDER BY range_pct ASC NULLS LAST)
        + (count(*) OVER (PARTITION BY f.pred_date, range_pct) - 1) / 2.0)
        / count(range_pct) OVER (PARTITION BY f.pred_date) END AS cs_rank_range_pct,
      (range_pct - avg(range_pct) OVER (PARTITION BY f.pred_date))
        / nullif(stddev_samp(range_pct) OVER (PARTITION BY f.pred_date), 0) AS cs_z_range_pct,
      CASE WHEN close_location IS NOT NULL THEN
        (rank() OVER (PARTITION BY f.pred_date ORDER BY close_location ASC NULLS LAST)
        + (count(*) OVER (PARTITION BY f.pred_date, close_location) - 1) / 2.0)
        / count(close_location) OVER (PARTITION BY f.pred_date) END AS cs_rank_close_location
    FROM facts f JOIN market m ON f.pred_date = m.pred_date)
  WHERE actual_return_pct IS NOT NULL AND split IS NOT NULL AND history_count >= 20)"""
