"""Data-quality checks as tables of (check, count)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import pct_change
from ..sources.staging import stage
from .ranking import quantiles


def non_finite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of missing, NaN or infinite values per column."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.agg(*[F.count_if(bad(c)).alias(c) for c in columns])


def require_finite(df: DataFrame, columns: list[str], what: str) -> None:
    bad = {c: n for c, n in non_finite_counts(df, columns).first().asDict().items() if n}
    if bad:
        raise AssertionError(f"{what} has missing or non-finite values: {bad}")


def unpivot_row(df: DataFrame, name: str, value: str, columns: list[str]) -> DataFrame:
    """A one-row table of numbers as (name, value) rows."""
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(F.explode(entries).alias("_e")).select("_e.*")


INTEGRITY_DETAIL = {"unscorable_rows": "missing next-session open"}


def integrity_report(daily: DataFrame, panel: DataFrame, sessions: DataFrame) -> DataFrame:
    """Twelve checks (check, value, detail) on daily bars, targets and the last session price.

    Distinct counts run on the grouped (symbol, date) keys; the 95th percentile of the
    close gap is exact and does not gather the gaps in one task.
    """
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    outside = (h < l) | (c > h) | (c < l) | (o > h) | (o < l)
    keys = daily.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("volume") < 0).alias("negative"),
        F.count_if(outside).alias("outside"), F.count_if(c <= 0).alias("nonpositive"))
    bars = keys.agg(
        F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("sessions"),
        F.sum("n").alias("daily_rows"), F.sum(F.col("n") - 1).alias("duplicate_symbol_date"),
        F.sum("negative").alias("negative_volume"), F.sum("outside").alias("ohlc_bound_violations"),
        F.sum("nonpositive").alias("nonpositive_close"))
    rows = panel.agg(
        F.count("actual_return_pct").alias("scorable_rows"),
        (F.count(F.lit(1)) - F.count("actual_return_pct")).alias("unscorable_rows"))
    gap = (pct_change("session_close", "close") * 100.0).alias("gap")
    gaps = stage(
        panel.select("symbol", "pred_date", "close").join(
            sessions.select("symbol", "pred_date", "session_close"), ["symbol", "pred_date"])
        .select(gap).where("gap is not null"), "close-gaps")
    moments = gaps.agg(F.round(F.avg("gap"), 4).alias("close_vs_1529_mean_bp"),
                       F.round(F.avg(F.abs("gap")), 4).alias("close_vs_1529_mean_abs_bp"))
    p95 = quantiles(gaps.select(F.abs("gap").alias("gap")), [], "gap", [0.95]).select(
        F.round("quantile", 4).alias("close_vs_1529_p95_abs_bp"))
    long = None
    for part in (bars, rows, moments, p95):
        entries = unpivot_row(part, "check", "value", part.columns)
        long = entries if long is None else long.unionByName(entries)
    detail = F.lit("")
    for check, text in INTEGRITY_DETAIL.items():
        detail = F.when(F.col("check") == check, text).otherwise(detail)
    return long.withColumn("detail", detail)


# fixed values: columns of the published tables
PREDICTION_COLUMNS = ["pred_date", "target_date", "symbol", "pred_magnitude_pct", "pred_direction",
                      "conf_direction", "conf_magnitude", "split"]
ACTUAL_COLUMNS = ["pred_date", "target_date", "symbol", "actual_return_pct", "actual_direction",
                  "actual_magnitude_pct", "universe_mean_pct"]
STATISTICS_COLUMNS = ["split", "scope", "metric", "value", "n_obs"]
STATISTICS_ROWS = 41


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of keys (with multiplicity) found on one side only."""
    count = lambda t, side: t.select(*keys, F.lit(side).alias("_s"))
    both = count(a, 1).unionAll(count(b, -1)).groupBy(*keys).agg(F.sum("_s").alias("d"))
    return both.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("key_differences"))


def interface_problems(preds: DataFrame, actuals: DataFrame, stats: DataFrame) -> DataFrame:
    """(problem, n) for every rule of the published interface; n counts violations."""
    columns = {
        "prediction_columns": preds.columns != PREDICTION_COLUMNS,
        "actual_columns": actuals.columns != ACTUAL_COLUMNS,
        "statistics_columns": stats.columns != STATISTICS_COLUMNS,
    }
    nulls = lambda t: sum((F.count_if(F.col(c).isNull()) for c in t.columns), F.lit(0))
    outside = lambda c, lo, hi: F.count_if(~F.col(c).between(lo, hi))
    infinite = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    p = preds.agg(
        nulls(preds).alias("prediction_nulls"),
        F.count_if(infinite("pred_magnitude_pct") | infinite("conf_direction") | infinite("conf_magnitude"))
        .alias("non_finite_predictions"),
        F.count_if(~F.col("pred_direction").isin(-1, 1)).alias("direction_domain"),
        F.count_if(F.col("pred_magnitude_pct") < 0).alias("negative_magnitude"),
        outside("conf_direction", 0.5, 1.0).alias("conf_direction_range"),
        outside("conf_magnitude", 0.0, 1.0).alias("conf_magnitude_range"))
    a = actuals.agg(nulls(actuals).alias("actual_nulls"))
    copies = preds.groupBy("pred_date", "symbol").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"))
    differing = key_differences(preds, actuals, ["pred_date", "symbol"])
    rows = stats.agg(F.count(F.lit(1)).alias("r")).crossJoin(
        preds.select("split").distinct().agg(F.count(F.lit(1)).alias("k"))).select(
        F.abs(F.col("r") - STATISTICS_ROWS * F.col("k")).alias("statistics_rows"))
    long = preds.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in columns.items()], "problem string, n double")
    for part in (p, a, copies, differing, rows):
        long = long.unionByName(unpivot_row(part, "problem", "n", part.columns))
    return long.select("problem", F.col("n").cast("bigint").alias("n"))


def derived_problems(actuals: DataFrame, tolerance: float = 5e-10) -> DataFrame:
    """(problem, n): magnitude, direction and session mean must follow from the returns."""
    r = F.col("actual_return_pct")
    days = actuals.groupBy("pred_date").agg(F.avg(r).alias("_mean"))
    rows = actuals.join(stage(days, "published-means"), "pred_date")
    close = lambda x, y: F.abs(x - y) <= tolerance + 1e-5 * F.abs(y)
    agg = rows.agg(
        F.count_if(~close(F.col("actual_magnitude_pct"), F.abs(r))).alias("magnitude_not_abs"),
        F.count_if(F.col("actual_direction") != F.when(r < 0, -1).otherwise(1)).alias("direction_inconsistent"),
        F.count_if(~close(F.col("universe_mean_pct"), F.col("_mean"))).alias("mean_inconsistent"))
    return unpivot_row(agg, "problem", "n", agg.columns).select("problem", F.col("n").cast("bigint").alias("n"))


def statistics_differences(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rows of two statistics tables that differ beyond the tolerance or exist once only."""
    keys = ["split", "scope", "metric"]
    both = stored.select(*keys, F.col("value").alias("stored_value"), F.col("n_obs").alias("stored_n")).join(
        recomputed.select(*keys, F.col("value").alias("value"), F.col("n_obs").alias("n")), keys, "full")
    same_value = F.col("stored_value").eqNullSafe(F.col("value")) | (
        F.abs(F.col("stored_value") - F.col("value")) <= tolerance * (1 + F.abs("value")))
    same = F.coalesce(same_value, F.lit(False)) & F.col("stored_n").eqNullSafe(F.col("n"))
    return both.where(~same)


def precision_problems(text: DataFrame, digits: dict[str, int]) -> DataFrame:
    """(problem, n): serialized numbers (string columns) that do not have the fixed number of decimals."""
    agg = text.agg(*[
        F.count_if(~F.coalesce(F.col(c).rlike(rf"^\d+\.\d{{{n}}}$"), F.lit(False))).alias(c) for c, n in digits.items()])
    return unpivot_row(agg, "problem", "n", agg.columns).select("problem", F.col("n").cast("bigint").alias("n"))


def target_mismatches(df: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: targets that cannot be rebuilt from the prices."""
    rebuilt = pct_change("target_open", "close")
    a = F.col("actual_return_pct")
    bad = F.abs(a - rebuilt) > tolerance + 1e-5 * F.abs(rebuilt)
    return df.agg(F.count_if(bad).alias("mismatches"), F.count(a).alias("n_rows"))


def _exponent(x: Column) -> Column:
    """The power of two that goes with a double's mantissa, with a bit to spare; missing for zeros and what is not finite.

    Scaling by a power of two is exact, so a logarithm that errs in its last place does not matter.
    """
    plain = (x == 0) | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~plain, F.greatest(F.floor(F.log2(F.abs(x)) + 1e-9), F.lit(-960)))


def _exact_text(x: Column, exponent: Column) -> Column:
    """Text of a double that differs wherever a bit does: its integer mantissa and its power of two.

    Zeros keep their sign; what is not finite has its name.
    """
    return F.when(exponent.isNull(), x.cast("string")).otherwise(F.concat(
        (x * F.pow(F.lit(2.0), 53 - exponent)).cast("bigint").cast("string"), F.lit("p"), exponent.cast("string")))


def row_numbers(df: DataFrame, columns: list[str], *keep: Column) -> DataFrame:
    """The columns ``keep`` and a 60-bit number of each row, in halves of 30 bits (_high, _low) that add up as integers.

    Each value's text comes after its length, so that no two rows read alike; a missing value has a mark of its own.
    Numbers with fractions go by their bits, moments as microseconds, arrays entry by entry.  Exponents, texts, marks and
    the number are projections of their own: each is worked out once, while an expression that holds the others would
    repeat them wherever it names them.
    """
    kinds = dict(df.dtypes)
    fractions = [c for c in columns if kinds[c] in ("double", "float")]

    def text(value: Column, kind: str) -> Column:
        if kind.startswith("array<"):
            return F.array_join(F.transform(value, lambda v: F.coalesce(text(v, kind[6:-1]), F.lit("~"))), ",")
        if kind in ("double", "float"):
            return _exact_text(value.cast("double"), _exponent(value.cast("double")))
        if kind.startswith("timestamp"):
            return F.unix_micros(value.cast("timestamp")).cast("string")
        return value.cast("string")

    kept = [k.alias(f"_k{i}") for i, k in enumerate(keep)]
    names = [f"_k{i}" for i in range(len(keep))]
    rows = df.select(*kept, *columns, *[_exponent(F.col(c).cast("double")).alias(f"_e_{c}") for c in fractions])
    texts = rows.select(*names, *[
        (_exact_text(F.col(c).cast("double"), F.col(f"_e_{c}")) if c in fractions else text(F.col(c), kinds[c])).alias(f"_t{i}")
        for i, c in enumerate(columns)])
    marks = [F.coalesce(F.concat(F.length(f"_t{i}"), F.lit(":"), f"_t{i}"), F.lit("~")) for i in range(len(columns))]
    number = F.conv(F.substring(F.md5(F.concat(*marks)), 1, 15), 16, 10).cast("bigint").alias("_number")
    return texts.select(*names, number).select(
        *names, F.shiftright("_number", 30).alias("_high"), F.col("_number").bitwiseAND((1 << 30) - 1).alias("_low"))


def _hash_sum() -> Column:
    """Sum of the numbers from the sums of their halves, which fit a long up to 2^33 rows."""
    whole = lambda c: F.sum(c).cast("decimal(19,0)")
    return (whole("_high") * F.lit(1 << 30).cast("decimal(10,0)") + whole("_low")).cast("decimal(38,0)")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and a hash sum that do not depend on row order or partitioning."""
    return row_numbers(df, columns).agg(F.count(F.lit(1)).alias("n_rows"), _hash_sum().cast("string").alias("hash_sum"))


def fingerprint_tree(df: DataFrame, columns: list[str], key: str, leaf: int = 1 << 10, fan: int = 1 << 5) -> DataFrame:
    """(level, part, n_rows, hash_sum): fingerprints of ranges of an integer key.

    Level 0 has ranges of ``leaf`` keys, each further level ``fan`` ranges of the one below in one, up to a single part.
    Sums add up, so a level is an aggregate of the one below and rows are read once; rows without a key are part null.
    """
    base = stage(row_numbers(df, columns, F.expr(f"floor({key} / {int(leaf)})")).groupBy(F.col("_k0").alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), _hash_sum().alias("hash_sum")), "fingerprint-leaves")
    levels, now, level = [], base, 0
    while True:
        levels.append(now.select(F.lit(level).alias("level"), F.col("part").cast("bigint").alias("part"), "n_rows",
                                 F.col("hash_sum").cast("decimal(38,0)").cast("string").alias("hash_sum")))
        bounds = now.agg(F.min("part"), F.max("part")).first()
        if bounds[0] == bounds[1]:
            break
        # parts -1 and 0 lie on both sides of zero, which no division brings together
        above = "if(part is null, null, 0)" if tuple(bounds) == (-1, 0) else f"floor(part / {int(fan)})"
        now = stage(now.groupBy(F.expr(above).cast("bigint").alias("part")).agg(
            F.sum("n_rows").alias("n_rows"), F.sum("hash_sum").alias("hash_sum")), "fingerprint-level")
        level += 1
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def changed_parts(current: DataFrame, stored: DataFrame, level: int = 0) -> DataFrame:
    """(part, n_rows, stored_rows) of the parts of a level that differ between two trees, in their order; missing on one side counts."""
    a = current.where(F.col("level") == level).select("part", "n_rows", "hash_sum")
    b = stored.where(F.col("level") == level).select(
        F.col("part").alias("_part"), F.col("n_rows").alias("stored_rows"), F.col("hash_sum").alias("stored_sum"))
    both = a.join(b, F.col("part").eqNullSafe(F.col("_part")), "full")
    same = (F.col("hash_sum") == F.col("stored_sum")) & (F.col("n_rows") == F.col("stored_rows"))
    return both.where(~F.coalesce(same, F.lit(False))).select(
        F.coalesce("part", "_part").alias("part"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("stored_rows", F.lit(0)).alias("stored_rows")).orderBy(F.asc_nulls_last("part"))


def frozen_status(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(table, status) of fingerprints (table, n_rows, hash_sum): frozen, changed, missing now or not stored."""
    b = stored.select("table", F.col("n_rows").alias("_rows"), F.col("hash_sum").alias("_sum"))
    status = F.when(F.col("_rows").isNull(), "not stored").when(F.col("n_rows").isNull(), "missing").when(
        (F.col("n_rows") == F.col("_rows")) & (F.col("hash_sum").eqNullSafe(F.col("_sum"))), "frozen").otherwise("changed")
    return current.join(b, "table", "full").select("table", status.alias("status"))


class FrozenInputChanged(RuntimeError):
    """Raised when frozen inputs are missing or differ from their stored fingerprint."""


def require_frozen(current: dict[str, DataFrame], stored: dict[str, tuple[int, str]]) -> None:
    """Compare fingerprints of named tables with the stored ones; refuse to go on otherwise."""
    missing = sorted(set(stored) - set(current))
    changed = []
    for name in sorted(set(stored) & set(current)):
        row = current[name].first()
        if (row.n_rows, row.hash_sum) != tuple(stored[name]):
            changed.append(name)
    if not stored or missing or changed:
        raise FrozenInputChanged(f"frozen inputs are not usable: missing={missing}, changed={changed}")
