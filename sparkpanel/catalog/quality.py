"""Integrity checks, the published interface and fingerprints."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.columns import hash_fraction
from ..operators import metrics as met, quality as qual
from ..sources import interface, tables
from ..sources.staging import checkpoint_root, stage
from .registry import query, rounded
from .scoring import STATS
from .sql import SCORED, TARGETS, fraction, with_


@query("integrity_checks", with_(TARGETS + """,
traded AS (
  SELECT symbol, date AS pred_date,
         CASE WHEN count(*) > 1 THEN sum(l_extendedprice) / sum(l_quantity) END AS session_close
  FROM trades GROUP BY symbol, date),
gaps AS (
  SELECT (t.session_close / p.close - 1.0) * 10000.0 AS gap
  FROM panel0 p JOIN traded t ON t.symbol = p.symbol AND t.pred_date = p.pred_date WHERE t.session_close IS NOT NULL)""", """
SELECT 'symbols' AS "check", count(DISTINCT symbol)::DOUBLE AS value, '' AS detail FROM daily
UNION ALL SELECT 'sessions', count(DISTINCT date), '' FROM daily
UNION ALL SELECT 'daily_rows', count(*), '' FROM daily
UNION ALL SELECT 'duplicate_symbol_date', count(*) - count(DISTINCT (symbol, date)), '' FROM daily
UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0), '' FROM daily
UNION ALL SELECT 'ohlc_bound_violations', count(*) FILTER (high < low OR close > high OR close < low OR open > high
  OR open < low), '' FROM daily
UNION ALL SELECT 'nonpositive_close', count(*) FILTER (close <= 0), '' FROM daily
UNION ALL SELECT 'scorable_rows', count(actual_return_pct), '' FROM panel0
UNION ALL SELECT 'unscorable_rows', count(*) - count(actual_return_pct), 'missing next-session open' FROM panel0
UNION ALL SELECT 'close_vs_1529_mean_bp', round(avg(gap), 4), '' FROM gaps
UNION ALL SELECT 'close_vs_1529_mean_abs_bp', round(avg(abs(gap)), 4), '' FROM gaps
UNION ALL SELECT 'close_vs_1529_p95_abs_bp', round(quantile_cont(abs(gap), 0.95), 4), '' FROM gaps"""))
def integrity_checks(spark, sf):
    """The day's average trade price stands in for the last session price."""
    from ..operators.calendar import overnight_targets

    daily, calendar = tables.daily_with_calendar(spark, sf)
    panel = stage(overnight_targets(daily, calendar).select(
        "symbol", "pred_date", "close", "actual_return_pct"), "targets")
    traded = tables.trade_ticks(spark, sf).groupBy("symbol", F.col("date").alias("pred_date")).agg(
        F.when(F.count(F.lit(1)) > 1, F.sum("l_extendedprice") / F.sum("l_quantity")).alias("session_close"))
    return qual.integrity_report(daily, panel, traded)


PUBLISHED = SCORED + """,
published AS (
  SELECT pred_date, target_date, symbol, split, round_even(greatest(pred_magnitude_pct, 0), 4) AS pred_magnitude_pct,
    pred_direction, round_even(least(greatest(conf_direction, 0.5), 1.0), 6) AS conf_direction,
    round_even(least(greatest(conf_magnitude, 0.0), 1.0), 6) AS conf_magnitude, actual_return_pct,
    CASE WHEN actual_return_pct < 0 THEN -1 ELSE 1 END AS actual_direction,
    abs(actual_return_pct) AS actual_magnitude_pct, avg(actual_return_pct) OVER (PARTITION BY pred_date)
      AS universe_mean_pct FROM scored)"""


@query("published_predictions", with_(PUBLISHED, """
SELECT pred_date, target_date, symbol, printf('%.4f', pred_magnitude_pct) AS pred_magnitude_pct, pred_direction,
  printf('%.6f', conf_direction) AS conf_direction, printf('%.6f', conf_magnitude) AS conf_magnitude, split
FROM published"""))
def published_predictions(spark, sf):
    return interface.prediction_text(interface.published_rows(tables.scored_frame(spark, sf)))


@query("published_actuals", with_(PUBLISHED, """
SELECT pred_date, target_date, symbol, round(round(actual_return_pct, 10), 6) AS actual_return_pct, actual_direction,
  round(round(actual_magnitude_pct, 10), 6) AS actual_magnitude_pct,
  round(round(universe_mean_pct, 10), 6) AS universe_mean_pct
FROM published"""))
def published_actuals(spark, sf):
    """The ten-digit text of the outcomes, compared as numbers with six digits."""
    text = interface.actual_text(interface.published_rows(tables.scored_frame(spark, sf)))
    return rounded(text.withColumns({
        c: F.col(c).cast("double") for c in ("actual_return_pct", "actual_magnitude_pct", "universe_mean_pct")}))


def published_folder(spark, sf) -> str:
    import uuid

    path = f"{checkpoint_root(spark)}/published-{uuid.uuid4().hex}"
    interface.write_outputs(tables.scored_frame(spark, sf), path)
    return path


# the statistics SQL over the published (rounded) rows
REPUBLISHED = PUBLISHED + """,
reread AS (
  SELECT pred_date, target_date, symbol, split, pred_magnitude_pct, pred_direction, conf_direction, conf_magnitude,
    CAST(printf('%.10f', actual_return_pct) AS DOUBLE) AS actual_return_pct,
    CAST(printf('%.10f', actual_magnitude_pct) AS DOUBLE) AS actual_magnitude_pct,
    CAST(printf('%.10f', universe_mean_pct) AS DOUBLE) AS universe_mean_pct FROM published),
rebased AS (
  SELECT *, CASE WHEN count(*) OVER w >= 20 THEN avg(actual_magnitude_pct) OVER w END AS vol_baseline_20 FROM reread
  WINDOW w AS (PARTITION BY symbol ORDER BY pred_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query("rescored_interface", with_(
    REPUBLISHED + STATS[len(SCORED):].replace("FROM scored", "FROM rebased"),
    "SELECT split, scope, metric, round(value, 6) AS value, n_obs FROM statistics"))
def rescored_interface(spark, sf):
    """Statistics of the CSV files that were written, read back from disk."""
    return rounded(interface.read_statistics(spark, published_folder(spark, sf)))


@query("interface_validation", """
SELECT problem, 0::BIGINT AS n FROM (SELECT unnest(['prediction_columns', 'actual_columns', 'statistics_columns',
  'prediction_nulls', 'non_finite_predictions', 'direction_domain', 'negative_magnitude', 'conf_direction_range',
  'conf_magnitude_range', 'actual_nulls', 'duplicate_keys', 'key_differences', 'statistics_rows']) AS problem)""")
def interface_validation(spark, sf):
    path = published_folder(spark, sf)
    preds, actuals = interface.read_outputs(spark, path)
    return qual.interface_problems(preds, actuals, interface.read_statistics(spark, path))


def _drawn(seed: int) -> str:
    return fraction(seed, "symbol", "pred_date")


@query("interface_violations", with_(PUBLISHED + f""",
broken AS (
  SELECT pred_date, symbol, split, CASE WHEN {_drawn(21)} >= 0.05 THEN target_date END AS target_date,
    CASE WHEN {_drawn(22)} < 0.1 THEN 'Infinity'::DOUBLE WHEN {_drawn(23)} < 0.2 THEN -pred_magnitude_pct
      ELSE pred_magnitude_pct END AS pred_magnitude_pct,
    CASE WHEN {_drawn(24)} < 0.1 THEN 0 ELSE pred_direction END AS pred_direction, conf_direction - 0.125 AS conf_direction,
    conf_magnitude + 0.25 AS conf_magnitude, {_drawn(25)} < 0.1 AS twice, {_drawn(26)} < 0.1 AS lost,
    {_drawn(27)} < 0.1 AS blank FROM published),
preds AS (SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE twice)""", """
SELECT 'prediction_columns' AS problem, 1::BIGINT AS n
UNION ALL SELECT 'actual_columns', 0 UNION ALL SELECT 'statistics_columns', 1
UNION ALL SELECT 'prediction_nulls', count(*) FILTER (target_date IS NULL) FROM preds
UNION ALL SELECT 'non_finite_predictions', count(*) FILTER (isinf(pred_magnitude_pct)) FROM preds
UNION ALL SELECT 'direction_domain', count(*) FILTER (pred_direction = 0) FROM preds
UNION ALL SELECT 'negative_magnitude', count(*) FILTER (pred_magnitude_pct < 0) FROM preds
UNION ALL SELECT 'conf_direction_range', count(*) FILTER (conf_direction < 0.5) FROM preds
UNION ALL SELECT 'conf_magnitude_range', count(*) FILTER (conf_magnitude > 1) FROM preds
UNION ALL SELECT 'actual_nulls', count(*) FILTER (blank AND NOT lost) FROM broken
UNION ALL SELECT 'duplicate_keys', count(*) FILTER (twice) FROM broken
UNION ALL SELECT 'key_differences', count(*) FILTER (twice) + count(*) FILTER (lost) FROM broken
UNION ALL SELECT 'statistics_rows', 40 * count(DISTINCT split) FROM preds"""))
def interface_violations(spark, sf):
    """The validator on published rows that break every rule on drawn rows, which SQL counts by itself."""
    u = lambda seed: hash_fraction(seed, "symbol", "pred_date")
    rows = stage(interface.published_rows(tables.scored_frame(spark, sf)), "published-rows")
    broken = rows.withColumns({
        "target_date": F.when(u(21) >= 0.05, F.col("target_date")),
        "pred_magnitude_pct": F.when(u(22) < 0.1, float("inf")).when(
            u(23) < 0.2, -F.col("pred_magnitude_pct")).otherwise(F.col("pred_magnitude_pct")),
        "pred_direction": F.when(u(24) < 0.1, 0).otherwise(F.col("pred_direction")),
        "conf_direction": F.col("conf_direction") - 0.125, "conf_magnitude": F.col("conf_magnitude") + 0.25})
    preds = broken.unionByName(broken.where(u(25) < 0.1)).select(*reversed(qual.PREDICTION_COLUMNS))
    actuals = rows.where(u(26) >= 0.1).withColumn(
        "universe_mean_pct", F.when(u(27) >= 0.1, F.col("universe_mean_pct"))).select(*qual.ACTUAL_COLUMNS)
    return qual.interface_problems(preds, actuals, preds.groupBy("split").count())


@query("derived_consistency", """
SELECT problem, 0::BIGINT AS n FROM (
  SELECT unnest(['magnitude_not_abs', 'direction_inconsistent', 'mean_inconsistent']) AS problem)""")
def derived_consistency(spark, sf):
    rows = interface.published_rows(tables.scored_frame(spark, sf))
    return qual.derived_problems(stage(rows.select(*qual.ACTUAL_COLUMNS), "published-actuals"))


@query("derived_violations", with_(SCORED, """
SELECT 'magnitude_not_abs' AS problem, count(*) FILTER (actual_return_pct < 0) AS n FROM scored
UNION ALL SELECT 'direction_inconsistent', count(*) FILTER (pred_direction <> CASE WHEN actual_return_pct < 0 THEN -1
  ELSE 1 END) FROM scored
UNION ALL SELECT 'mean_inconsistent', count(*) FILTER (abs(actual_return_pct - universe_mean_pct)
  > 5e-10 + 1e-5 * abs(universe_mean_pct)) FROM scored"""))
def derived_violations(spark, sf):
    """The same check on deliberately wrong columns: signed magnitude, forecast in place of the outcome sign, a row's own
    return in place of the session mean."""
    rows = tables.scored_frame(spark, sf).select(
        "pred_date", "actual_return_pct", F.col("actual_return_pct").alias("universe_mean_pct"),
        F.col("actual_return_pct").alias("actual_magnitude_pct"),
        F.col("pred_direction").alias("actual_direction"))
    return qual.derived_problems(rows)


@query("stats_recompute_diff", with_(SCORED, """
SELECT split, scope, metric, NULL::DOUBLE AS stored_value, NULL::BIGINT AS stored_n, NULL::DOUBLE AS value, NULL::BIGINT AS n
FROM (SELECT split, 'x' AS scope, 'x' AS metric FROM scored WHERE split = 'no such split')"""))
def stats_recompute_diff(spark, sf):
    """Differences between the stored statistics and a recomputation from the stored files: none."""
    path = published_folder(spark, sf)
    return qual.statistics_differences(
        interface.read_statistics(spark, path), interface.rescored(*interface.read_outputs(spark, path)))


@query("stats_changed_diff", with_(STATS, """
SELECT split, scope, metric, CASE WHEN split = 'valid' THEN round(value + 1, 6) END AS stored_value,
  CASE WHEN split = 'valid' THEN n_obs END AS stored_n, round(value, 6) AS value, n_obs AS n FROM statistics
WHERE (split = 'valid' AND value IS NOT NULL) OR (split = 'test' AND scope = 'residual')"""))
def stats_changed_diff(spark, sf):
    """Differences from a stored table with other values on validation and without the residual rows of the test block."""
    table = stage(met.statistics_table(tables.scored_frame(spark, sf)), "statistics")
    stored = table.where("not (split = 'test' and scope = 'residual')").withColumn(
        "value", F.when(F.col("split") == "valid", F.col("value") + 1).otherwise(F.col("value")))
    return rounded(qual.statistics_differences(stored, table))


@query("serialized_precision", with_(SCORED, """
SELECT problem, 0::BIGINT AS n FROM (
  SELECT unnest(['pred_magnitude_pct', 'conf_direction', 'conf_magnitude']) AS problem)"""))
def serialized_precision(spark, sf):
    text = spark.read.csv(f"{published_folder(spark, sf)}/predictions", header=True)
    return qual.precision_problems(text, interface.DIGITS)


@query("precision_violations", with_(PUBLISHED, f"""
SELECT 'pred_magnitude_pct' AS problem, count(*) FILTER ({_drawn(31)} < 0.1) AS n FROM published
UNION ALL SELECT 'conf_direction', count(*) FILTER ({_drawn(32)} < 0.1) FROM published
UNION ALL SELECT 'conf_magnitude', count(*) FILTER ({_drawn(33)} < 0.1) FROM published"""))
def precision_violations(spark, sf):
    """The precision check on text with a digit too few, a sign or no text on drawn rows."""
    u = lambda seed: hash_fraction(seed, "symbol", "pred_date")
    text = interface.prediction_text(interface.published_rows(tables.scored_frame(spark, sf))).withColumns({
        "pred_magnitude_pct": F.when(u(31) < 0.1, F.expr("left(pred_magnitude_pct, length(pred_magnitude_pct) - 1)"))
        .otherwise(F.col("pred_magnitude_pct")),
        "conf_direction": F.when(u(32) < 0.1, F.concat(F.lit("-"), "conf_direction")).otherwise(F.col("conf_direction")),
        "conf_magnitude": F.when(u(33) >= 0.1, F.col("conf_magnitude"))})
    return qual.precision_problems(text, interface.DIGITS)


@query("target_violations", with_(TARGETS, f"""
SELECT count(*) FILTER ({_drawn(34)} < 0.1 AND abs(actual_return_pct - (target_open / (close * 2) - 1) * 100)
    > 1e-12 + 1e-5 * abs((target_open / (close * 2) - 1) * 100)) AS mismatches, count(actual_return_pct) AS n_rows FROM panel0"""))
def target_violations(spark, sf):
    """The same check after the prices of drawn rows were doubled."""
    panel = tables.target_panel(spark, sf)
    return qual.target_mismatches(panel.withColumn("close", F.when(
        hash_fraction(34, "symbol", "pred_date") < 0.1, F.col("close") * 2).otherwise(F.col("close"))))


@query("target_reconstruction", with_(TARGETS, """
SELECT 0::BIGINT AS mismatches, count(actual_return_pct) AS n_rows FROM panel0"""))
def target_reconstruction(spark, sf):
    return qual.target_mismatches(tables.target_panel(spark, sf))


@query("key_panel_equality", with_(SCORED, """
SELECT CAST(count(*) FILTER (mag_mean_60 IS NULL) AS BIGINT) AS key_differences FROM scored"""))
def key_panel_equality(spark, sf):
    """Keys of the scored rows against those with a long history."""
    rows = tables.scored_frame(spark, sf)
    return qual.key_differences(rows, rows.where("mag_mean_60 is not null"), ["pred_date", "symbol"])


# ---- fingerprints ---------------------------------------------------------------------
def _exact_sql(x: str) -> str:
    e = f"greatest(floor(log2(abs({x})) + 1e-9), -960)::BIGINT"
    return (f"CASE WHEN {x} = 0 THEN CAST({x} AS VARCHAR) ELSE concat(CAST(({x} * pow(2.0, 53 - {e})) AS BIGINT), 'p', {e}) END")


def _value_sql(c: str, kind: str) -> str:
    if kind == "double":
        return _exact_sql(c)
    if kind == "floats":
        return f"array_to_string([{_exact_sql('v::DOUBLE')} for v in {c}], ',')"
    return f"CAST(epoch_us({c}) AS VARCHAR)" if kind == "moment" else f"CAST({c} AS VARCHAR)"


def row_hash_sql(columns: dict[str, str]) -> str:
    text = ", ".join(f"CASE WHEN {c} IS NULL THEN '~' ELSE concat(length({v}), ':', {v}) END"
                     for c, kind in columns.items() for v in [_value_sql(c, kind)])
    return f"CAST(('0x' || substr(md5(concat({text})), 1, 15)) AS BIGINT)"


def _columns(names: str, **kinds: str) -> dict[str, str]:
    return {c: kinds.get(c, "plain") for c in names.split()}


FINGERPRINTED = {
    "region": _columns("r_regionkey r_name"),
    "nation": _columns("n_nationkey n_name n_regionkey"),
    "customer": _columns("c_custkey c_name c_nationkey c_acctbal c_mktsegment", c_acctbal="double"),
    "supplier": _columns("s_suppkey s_name s_nationkey s_acctbal", s_acctbal="double"),
    "part": _columns("p_partkey p_name p_brand p_type p_size p_retailprice", p_retailprice="double"),
    "orders": _columns("o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", o_totalprice="double", o_orderdate="moment"),
    "lineitem": _columns("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
                         l_quantity="double", l_extendedprice="double", l_discount="double", l_tax="double", l_shipdate="moment"),
    "events": _columns("event_id ts user_id event_type value props", ts="moment", value="double"),
    "documents": _columns("doc_id text lang source n_chars"),
    "embeddings": _columns("vec_id embedding label", embedding="floats"),
    "pages": _columns("page_id url html"),
    "benchmark": _columns("item_id text"),
    "labels": _columns("doc_id quality toxic"),
    "conversations": _columns("conv_id turn role text"),
}


def _fingerprint_sql(table: str, source: str | None = None) -> str:
    return (f"SELECT '{table}' AS \"table\", count(*) AS n_rows, CAST(sum({row_hash_sql(FINGERPRINTED[table])}) AS VARCHAR) AS hash_sum "
            f"FROM {source or table}")


def fingerprints(spark, sf, names=FINGERPRINTED, **changed):
    parts = [qual.fingerprint(changed.get(n, tables.table(spark, sf, n)), list(FINGERPRINTED[n])).select(F.lit(n).alias("table"), "*") for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("dataset_fingerprint", "\nUNION ALL\n".join(map(_fingerprint_sql, FINGERPRINTED)))
def dataset_fingerprint(spark, sf):
    """All given tables by the bits of their values."""
    return fingerprints(spark, sf)


LEAF, FAN = 512, 32


@query("fingerprint_tree", f"""
WITH RECURSIVE leaves AS (
  SELECT CAST(floor(l_orderkey / {LEAF}) AS BIGINT) AS part, count(*) AS n_rows, sum({row_hash_sql(FINGERPRINTED['lineitem'])}) AS s
  FROM lineitem GROUP BY 1),
heights AS (SELECT 0 AS level, 1::BIGINT AS width, min(part) AS low, max(part) AS high FROM leaves
  UNION ALL SELECT level + 1, width * {FAN}, CAST(floor(low / {FAN}) AS BIGINT), CAST(floor(high / {FAN}) AS BIGINT) FROM heights WHERE low < high)
SELECT level, CAST(floor(part / width) AS BIGINT) AS part, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(s) AS VARCHAR) AS hash_sum
FROM leaves, heights GROUP BY 1, 2""")
def fingerprint_tree(spark, sf):
    return qual.fingerprint_tree(tables.table(spark, sf, "lineitem"), list(FINGERPRINTED["lineitem"]), "l_orderkey", LEAF, FAN)


def _last_bit(lines):
    """Line items whose discount is larger by the last bit in one order of every thousand."""
    touched = (F.col("l_orderkey") % 1000 == 7) & (F.col("l_discount") > 0)
    return lines.withColumn("l_discount", F.when(touched, F.col("l_discount") * (1 + 2.0 ** -52)).otherwise(F.col("l_discount")))


@query("fingerprint_changes", f"""
SELECT CAST(floor(l_orderkey / {LEAF}) AS BIGINT) AS part, count(*) AS n_rows, count(*) AS stored_rows FROM lineitem
GROUP BY 1 HAVING count(*) FILTER (l_orderkey % 1000 = 7 AND l_discount > 0) > 0""")
def fingerprint_changes(spark, sf):
    """Ranges of orders in which a change of the last bit is found."""
    lines = tables.table(spark, sf, "lineitem")
    tree = lambda t: qual.fingerprint_tree(t, list(FINGERPRINTED["lineitem"]), "l_orderkey", LEAF, FAN)
    return qual.changed_parts(tree(_last_bit(lines)), tree(lines))


@query("frozen_inputs", "SELECT t AS \"table\", CASE t WHEN 'lineitem' THEN CASE WHEN (SELECT count(*) FROM lineitem WHERE l_orderkey % 1000 = 7"
       " AND l_discount > 0) > 0 THEN 'changed' ELSE 'frozen' END WHEN 'orders' THEN 'missing' WHEN 'part' THEN 'not stored'"
       " ELSE 'frozen' END AS status FROM (SELECT unnest(['region', 'nation', 'events', 'lineitem', 'orders', 'part']) AS t)")
def frozen_inputs(spark, sf):
    """Stored fingerprints against tables of which one has changed, one is gone and one is new."""
    stored = fingerprints(spark, sf, ["region", "nation", "events", "lineitem", "orders"])
    current = fingerprints(spark, sf, ["region", "nation", "events", "lineitem", "part"],
                           lineitem=_last_bit(tables.table(spark, sf, "lineitem")))
    return qual.frozen_status(current, stored)
