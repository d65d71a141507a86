"""Bootstrap intervals on the scored frame."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as boot
from ..sources import tables
from .registry import query, rounded
from .scoring import RIVALS, rival
from .sql import SCORED, bucket, with_

DRAWS = 2000


def blocks_sql(name: str, where: str, terms: str) -> str:
    return f"""{name}_blocks AS (
  SELECT block, {", ".join(f"sum({t}) AS {t}" for t in ("na", "nb", "den"))} FROM (
    SELECT (row_number() OVER (ORDER BY pred_date) - 1) // 5 AS block, na, nb, den FROM (
      SELECT pred_date, {terms} FROM scored WHERE {where} GROUP BY pred_date)) GROUP BY block)"""


def interval_sql(name: str, seed: int, diff: str, label: str = "", draws: int = DRAWS) -> str:
    return f"""
SELECT {label}round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS ci_low,
  round(quantile_cont(diff, 0.975), 6) AS ci_high
FROM (
  SELECT draw, {diff} AS diff
  FROM (SELECT draw, sum(na) AS na, sum(nb) AS nb, sum(den) AS den
        FROM (SELECT d.draw, {bucket(seed, f"(SELECT count(*) FROM {name}_blocks)", "d.draw", "s.slot")} AS block
              FROM range({draws}) d(draw), range((SELECT count(*) FROM {name}_blocks)) s(slot)) p
        JOIN {name}_blocks b ON b.block = p.block GROUP BY draw))"""


DIRECTION = "sum({d} * {t}) AS na, sum({b} * {t}) AS nb, sum(abs({t})) AS den"
MAGNITUDE = ("sum(abs(pred_magnitude_pct - actual_magnitude_pct)) AS na, "
             "sum(abs({b} - actual_magnitude_pct)) AS nb, sum(actual_magnitude_pct) AS den")
RESIDUAL = "(actual_return_pct - universe_mean_pct)"
RATIO, SHORTFALL = "na / den - nb / den", "nb / den - na / den"


@query("bootstrap_direction", with_(SCORED + ",\n" + blocks_sql(
    "b", "split = 'valid'", DIRECTION.format(d="pred_direction", b="1.0", t="actual_return_pct")),
    interval_sql("b", 43, RATIO)))
def bootstrap_direction(spark, sf):
    rows = tables.scored_frame(spark, sf).where("split = 'valid'")
    return rounded(boot.direction_diff(
        rows, F.col("pred_direction"), F.lit(1.0), F.col("actual_return_pct"), draws=DRAWS, seed=43))


@query("bootstrap_magnitude", with_(SCORED + ",\n" + blocks_sql(
    "b", "split = 'valid' AND mag_mean_60 IS NOT NULL", MAGNITUDE.format(b="mag_mean_60")),
    interval_sql("b", 44, SHORTFALL)))
def bootstrap_magnitude(spark, sf):
    rows = tables.scored_frame(spark, sf).where("split = 'valid' and mag_mean_60 is not null")
    return rounded(boot.magnitude_diff(
        rows, F.col("pred_magnitude_pct"), F.col("mag_mean_60"), F.col("actual_magnitude_pct"), draws=DRAWS, seed=44))


def _weighted_rank(v: str) -> str:
    return (f"sum(w) OVER (PARTITION BY draw ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
            f"- (sum(w) OVER (PARTITION BY draw, {v}) - 1) / 2.0")


def _weighted_corr(x: str, y: str) -> str:
    cov = lambda a, b: f"(sum(w * {a} * {b}) - sum(w * {a}) * sum(w * {b}) / sum(w))"
    return f"{cov(x, y)} / sqrt({cov(x, x)} * {cov(y, y)})"


def spearman_sql(name: str, split: str, seed: int) -> str:
    """CTEs that end in ``{name}_ranked``: weighted ranks of every row in every draw."""
    return f"""{name}_base AS (
  SELECT (dense_rank() OVER (ORDER BY pred_date) - 1) // 5 AS block, conf_magnitude AS a, -pred_magnitude_pct AS b,
    -abs(pred_magnitude_pct - actual_magnitude_pct) AS y FROM scored WHERE split = '{split}'),
{name}_n AS (SELECT max(block) + 1 AS n FROM {name}_base),
{name}_times AS (
  SELECT draw, block, count(*) AS w
  FROM (SELECT d.draw, {bucket(seed, f'(SELECT n FROM {name}_n)', 'd.draw', 's.slot')} AS block
        FROM range({DRAWS}) d(draw), range((SELECT n FROM {name}_n)) s(slot)) GROUP BY ALL),
{name}_copies AS (SELECT t.draw, t.w, b.a, b.b, b.y FROM {name}_times t JOIN {name}_base b ON b.block = t.block),
{name}_ranked AS (
  SELECT draw, w, {_weighted_rank('a')} AS ra, {_weighted_rank('b')} AS rb, {_weighted_rank('y')} AS ry FROM {name}_copies)"""


def spearman_interval_sql(name: str, label: str = "") -> str:
    return f"""
SELECT {label}round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS ci_low,
  round(quantile_cont(diff, 0.975), 6) AS ci_high
FROM (SELECT draw, {_weighted_corr('ra', 'ry')} - {_weighted_corr('rb', 'ry')} AS diff FROM {name}_ranked GROUP BY draw)"""


def table_sql() -> str:
    ctes, selects = [], []
    for i, split in enumerate(("valid", "test")):
        for k, (name, where, terms, diff) in enumerate((
                ("residual_vs_zero", "", DIRECTION.format(d="pred_direction", b="0.0", t=RESIDUAL), RATIO),
                ("pooled_vs_always_up", "", DIRECTION.format(d="pred_direction", b="1.0", t="actual_return_pct"), RATIO),
                ("magnitude_vs_trailing", " AND vol_baseline_20 IS NOT NULL",
                 MAGNITUDE.format(b="vol_baseline_20"), SHORTFALL))):
            ctes.append(blocks_sql(f"{split}_{k}", f"split = '{split}'{where}", terms))
            selects.append(interval_sql(f"{split}_{k}", 42 + 10 * i + k, diff,
                                        f"'{split}' AS split, '{name}' AS comparison, "))
        ctes.append(spearman_sql(split, split, 45 + 10 * i))
        selects.append(spearman_interval_sql(split, f"'{split}' AS split, 'confidence_vs_neg_magnitude' AS comparison, "))
    return with_(SCORED + ",\n" + ",\n".join(ctes), "\nUNION ALL\n".join(selects))


@query("bootstrap_table", table_sql())
def bootstrap_table(spark, sf):
    return rounded(boot.comparison_table(tables.scored_frame(spark, sf), draws=DRAWS))


def systems_sql() -> str:
    both = """,
pairs AS (
  SELECT f.pred_date, f.actual_return_pct, f.universe_mean_pct, f.pred_direction AS d, e.pred_direction AS r
  FROM systems f JOIN systems e USING (pred_date, symbol) WHERE f.system = 'fresh' AND e.system = 'existing')"""
    parts, selects = [], []
    for name, target in (("pooled", "actual_return_pct"), ("residual", RESIDUAL)):
        sums = f"sum(d * {target}) AS na, sum(r * {target}) AS nb, sum(abs({target})) AS den"
        parts.append(blocks_sql(name, "true", sums).replace("FROM scored", "FROM pairs"))
        selects.append(interval_sql(name, 42, RATIO, f"'{name}' AS comparison, ", 1000))
    return with_(RIVALS + both + ",\n" + ",\n".join(parts), "\nUNION ALL\n".join(selects))


@query("bootstrap_systems", systems_sql())
def bootstrap_systems(spark, sf):
    valid = tables.scored_frame(spark, sf).where("split = 'valid'")
    return rounded(boot.system_intervals(valid, rival(valid)))


@query("bootstrap_spearman", with_(SCORED + ",\n" + spearman_sql("v", "valid", 45), spearman_interval_sql("v")))
def bootstrap_spearman(spark, sf):
    m, err = F.col("pred_magnitude_pct"), F.abs(F.col("pred_magnitude_pct") - F.col("actual_magnitude_pct"))
    rows = tables.scored_frame(spark, sf).where("split = 'valid'").select(
        "pred_date", "symbol", "conf_magnitude", (-m).alias("neg_m"), (-err).alias("neg_err"))
    return rounded(boot.spearman_diff(
        rows, "conf_magnitude", "neg_m", "neg_err", ["pred_date", "symbol"], draws=DRAWS, seed=45))
