"""Isotonic calibration of the direction and magnitude confidences.

The SQL takes the fit from its definition: the greatest convex minorant of the cumulative sums, whose corners are the points
with larger slopes to every point on their right than from every point on their left.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as calib
from ..operators.isotonic import fit_isotonic, isotonic_knots, read_curve
from ..plans import confidence as conf
from ..sources import tables
from ..sources.staging import stage
from .calibration import INPUTS, REPORT, direction_rows, direction_table_sql
from .registry import query, rounded
from .sql import SCORED, round_all, with_


def curve_sql(name: str, rows: str, x: str, y: str) -> str:
    """CTE ``{name}_knots`` (x, value) of the increasing fit of y on x over ``rows``."""
    return f"""{name}_points AS (
  SELECT row_number() OVER (ORDER BY x) AS i, x, sum(s) OVER (ORDER BY x) AS s, sum(w) OVER (ORDER BY x) AS w FROM (
    SELECT {x} AS x, sum({y}) AS s, count(*)::DOUBLE AS w FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)
  UNION ALL SELECT 0, NULL, 0, 0),
{name}_left AS (SELECT b.i, max((b.s - a.s) / (b.w - a.w)) AS slope FROM {name}_points a JOIN {name}_points b ON a.i < b.i GROUP BY b.i),
{name}_right AS (SELECT a.i, min((b.s - a.s) / (b.w - a.w)) AS slope FROM {name}_points a JOIN {name}_points b ON a.i < b.i GROUP BY a.i),
{name}_corners AS (
  SELECT p.* FROM {name}_points p LEFT JOIN {name}_left l USING (i) LEFT JOIN {name}_right r USING (i)
  WHERE l.slope IS NULL OR r.slope IS NULL OR l.slope < r.slope),
{name}_blocks AS (
  SELECT i AS upto, lag(i) OVER o AS after, (s - lag(s) OVER o) / (w - lag(w) OVER o) AS value FROM {name}_corners WINDOW o AS (ORDER BY i)),
{name}_knots AS (SELECT p.x, b.value FROM {name}_points p JOIN {name}_blocks b ON p.i > b.after AND p.i <= b.upto)"""


def read_sql(name: str, rows: str, x: str, columns: str, out: str) -> str:
    """The curve at ``x`` for each of ``rows``, linear between its knots and constant beyond them."""
    return f"""(SELECT {columns}, CASE WHEN a.x IS NULL THEN b.value WHEN b.x IS NULL OR a.value = b.value THEN a.value
    ELSE a.value + (b.value - a.value) * (r.{x} - a.x) / (b.x - a.x) END AS {out}
  FROM {rows} r ASOF LEFT JOIN {name}_knots a ON r.{x} >= a.x ASOF LEFT JOIN {name}_knots b ON r.{x} <= b.x)"""


JUDGED = INPUTS + """,
judged AS (
  SELECT *, CASE WHEN base_direction > 0 THEN p_up ELSE 1 - p_up END AS emitted, abs(mu_total) AS margin,
    (base_direction = CASE WHEN actual_return_pct >= 0 THEN 1 ELSE -1 END)::INT::DOUBLE AS right_way FROM inputs),
fitted AS (SELECT * FROM judged WHERE split = 'train'),
seen AS (SELECT * FROM judged WHERE split = 'valid')"""
ISOTONIC = JUDGED + ",\n" + curve_sql("raw", "fitted", "emitted", "right_way") + ",\n" + curve_sql("margin", "fitted", "margin", "right_way") + """,
entries AS (
  SELECT 'C0_constant' AS model, base_direction, actual_return_pct AS a, (SELECT avg(right_way) FROM fitted) AS q FROM seen
  UNION ALL SELECT 'C3_isotonic', base_direction, a, least(greatest(q, 1e-6), 1 - 1e-6) FROM """ + read_sql(
    "raw", "seen", "emitted", "base_direction, actual_return_pct AS a", "q") + """
  UNION ALL SELECT 'C5_isotonic_margin', base_direction, a, least(greatest(q, 1e-6), 1 - 1e-6) FROM """ + read_sql(
    "margin", "seen", "margin", "base_direction, actual_return_pct AS a", "q") + ")"


@query("isotonic_confidence", with_(direction_table_sql(ISOTONIC), f"SELECT model, {round_all(REPORT)}, flips FROM table0"))
def isotonic_confidence(spark, sf):
    rows = stage(direction_rows(spark, sf), "confidence-rows")
    table = conf.direction_candidates(rows.where("split = 'train'"), rows.where("split = 'valid'"),
                                      ["C0_constant", "C3_isotonic", "C5_isotonic_margin"])[0]
    return rounded(table.withColumn("lift", F.when(F.abs("lift") < 1e-12, 0.0).otherwise(F.col("lift"))))


@query("isotonic_curve", with_(JUDGED + ",\n" + curve_sql("raw", "fitted", "emitted", "right_way"),
                               "SELECT DISTINCT round(x, 6) AS x, round(value, 6) AS value FROM raw_knots k"
                               " WHERE x = (SELECT min(x) FROM raw_knots o WHERE o.value = k.value)"
                               " OR x = (SELECT max(x) FROM raw_knots o WHERE o.value = k.value)"))
def isotonic_curve(spark, sf):
    """Corners of the fitted curve itself."""
    rows = direction_rows(spark, sf).where("split = 'train'")
    return rounded(isotonic_knots(rows, "p_up_emitted", "correct")).distinct()


RISK = SCORED + """,
errors AS (SELECT *, abs(pred_magnitude_pct - actual_magnitude_pct) AS err FROM scored),
fitted AS (SELECT * FROM errors WHERE split = 'train'),
""" + curve_sql("scale", "fitted", "pred_magnitude_pct", "err") + """,
known AS (SELECT risk FROM """ + read_sql("scale", "fitted", "pred_magnitude_pct", "r.symbol", "risk") + """),
risks AS (
  SELECT pred_date, symbol, risk FROM """ + read_sql(
    "scale", "errors", "pred_magnitude_pct", "r.pred_date, r.symbol, r.split", "risk") + """ WHERE split = 'valid'),
ladder AS (SELECT risk, sum(n) OVER (ORDER BY risk) - n AS below FROM (
  SELECT risk, sum(n) AS n FROM (SELECT risk, 1 AS n FROM known UNION ALL SELECT risk, 0 FROM risks) GROUP BY risk))"""


@query("scale_only_reliability", with_(RISK, """
SELECT pred_date, symbol, round(risks.risk, 6) AS risk, round(1 - below / (SELECT count(*) FROM known)::DOUBLE, 6) AS confidence
FROM risks JOIN ladder USING (risk)"""))
def scale_only_reliability(spark, sf):
    """Predicted error of the forecast's size alone, and its place among those of training."""
    rows = tables.scored_frame(spark, sf).withColumn(
        "oof_abs_error", F.abs(F.col("pred_magnitude_pct") - F.col("actual_magnitude_pct")))
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    fit = fit_isotonic(train, "pred_magnitude_pct", "oof_abs_error")
    scored = calib.ecdf_confidence(fit(valid, "risk"), fit(train, "risk"), "risk", ["pred_date", "symbol"])
    return rounded(scored.select("pred_date", "symbol", "risk", "confidence"))
