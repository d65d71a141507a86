"""Master calendar, next-session targets, embargoed splits and expanding folds."""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import finite, pct_change
from ..sources.staging import stage

MODES = ("research", "final-test")


class TestQuarantineError(RuntimeError):
    """Raised for a mode that is neither research nor final-test."""

    __test__ = False


def session_calendar(daily: DataFrame, date_col: str = "date") -> DataFrame:
    """One row per observed session: session, session_idx (0-based), next_session.

    The table has at most one row per calendar day, so its window may run in one task.
    """
    w = Window.orderBy("session")
    days = daily.select(F.col(date_col).alias("session")).where("session is not null").distinct()
    return days.select(
        "session",
        (F.row_number().over(w) - 1).alias("session_idx"),
        F.lead("session").over(w).alias("next_session"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a guard that travels with the plan: a key with several rows fails the job that reads its columns.

    The rows of a key are counted where they are aggregated anyway, before a join on the key; nothing runs here.
    """
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.any_value(F.struct(*rest, F.lit(1).alias("_one"))).alias("_row"))
    names = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("missing")) for k in keys])
    failed = F.raise_error(F.concat(F.lit(f"several rows for {', '.join(keys)}: "), names)).cast(one.schema["_row"].dataType)
    guarded = one.withColumn("_row", F.when(F.col("_rows") > 1, failed).otherwise(F.col("_row")))
    return guarded.where("_row._one = 1").select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that insists on unique keys on the right side, whenever a plan reads one of its columns."""
    return left.join(unique_rows(right, keys), keys, "left")


def overnight_targets(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Return from this close to the open of the next *calendar* session.

    A symbol that does not trade on the next calendar session has no target; it never
    borrows a later session.  (symbol, date) is unique, so a row's target can only be
    on the symbol's own next row: one window sorted by date replaces the self-join, and
    the window partitions are bounded by the number of sessions.
    """
    w = Window.partitionBy("symbol").orderBy("pred_date")
    panel = lookup_join(
        daily.withColumnRenamed("date", "pred_date"),
        calendar.select(F.col("session").alias("pred_date"), F.col("next_session").alias("target_date")), ["pred_date"])
    # the window sees copies of a key side by side
    copied = F.coalesce(F.lag("pred_date").over(w) == F.col("pred_date"), F.lit(False))
    refused = F.raise_error(F.concat(
        F.lit("several rows for symbol, date: "), F.col("symbol"), F.lit(", "), F.col("pred_date").cast("string")))
    on_next = F.when(copied, refused.cast("boolean")).otherwise(F.lead("pred_date").over(w) == F.col("target_date"))
    panel = panel.select(
        "*",
        F.when(on_next, F.lead("open").over(w)).alias("target_open"),
        F.when(on_next, F.lead("close").over(w)).alias("target_close"),
    )
    # a NaN price would count as positive
    scorable = F.col("target_date").isNotNull() & (finite("close") > 0) & (finite("target_open") > 0)
    panel = panel.withColumn("actual_return_pct", F.when(scorable, pct_change("target_open", "close")))
    return panel.withColumn("actual_magnitude_pct", F.abs("actual_return_pct")).withColumn(
        "actual_direction",
        F.when(F.col("actual_return_pct") < 0, -1).when(F.col("actual_return_pct").isNotNull(), 1))


@dataclass(frozen=True)
class SplitBounds:
    train_end: date
    valid_start: date
    valid_end: date
    test_start: date
    train_valid_embargo: tuple[date, ...]
    valid_test_embargo: tuple[date, ...]


def split_bounds_table(calendar: DataFrame, train_end: str, valid_end: str, embargo: int) -> DataFrame:
    """One row: train_end, valid_start, valid_end, test_start and the two embargo lists."""
    idx_at = lambda limit: F.max(F.when(F.col("session") <= F.to_date(F.lit(limit)), F.col("session_idx")))
    last = calendar.agg(idx_at(train_end).alias("tr"), idx_at(valid_end).alias("va"))
    day = lambda k: F.max(F.when(F.col("session_idx") == k, F.col("session")))
    between = lambda k: F.sort_array(F.collect_list(F.when(
        (F.col("session_idx") > k) & (F.col("session_idx") <= k + embargo), F.col("session"))))
    tr, va = F.col("tr"), F.col("va")
    return calendar.crossJoin(last).agg(
        day(tr).alias("train_end"), day(tr + embargo + 1).alias("valid_start"),
        day(va).alias("valid_end"), day(va + embargo + 1).alias("test_start"),
        between(tr).alias("train_valid_embargo"), between(va).alias("valid_test_embargo"),
    )


def split_bounds(calendar: DataFrame, train_end: str, valid_end: str, embargo: int) -> SplitBounds:
    row = split_bounds_table(calendar, train_end, valid_end, embargo).first()
    if row.train_end is None or row.valid_start is None:
        raise ValueError("the calendar ends inside the embargo that follows the training block")
    if row.valid_end is None or row.valid_end < row.valid_start or row.test_start is None:
        raise ValueError("the calendar ends inside the embargo that follows the validation block")
    return SplitBounds(row.train_end, row.valid_start, row.valid_end, row.test_start,
                       tuple(row.train_valid_embargo), tuple(row.valid_test_embargo))


def label_splits(panel: DataFrame, bounds: SplitBounds) -> DataFrame:
    """Add split = train / valid / test; embargoed rows keep a null label."""
    d = F.col("pred_date")
    return panel.withColumn(
        "split",
        F.when(d <= bounds.train_end, "train")
        .when(d.between(bounds.valid_start, bounds.valid_end), "valid")
        .when(d >= bounds.test_start, "test"))


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise TestQuarantineError(f"mode is {mode!r}, expected research or final-test")


def quarantine(df: DataFrame, mode: str, test_start: date | None = None, date_col: str = "pred_date") -> DataFrame:
    """Drop the test block in research mode.

    With ``test_start`` the cut is a plain date filter that reaches the scan, for use
    before targets and features exist; otherwise the split label decides.
    """
    check_mode(mode)
    if mode == "final-test":
        return df
    if test_start is not None:
        return df.where(F.col(date_col) < F.lit(test_start))
    return df.where(F.col("split").isNull() | (F.col("split") != "test"))


def scorable_rows(features: DataFrame, min_history: int = 20) -> DataFrame:
    return features.where(
        F.col("actual_return_pct").isNotNull() & F.col("split").isNotNull()
        & (F.col("history_count") >= min_history))


def expanding_folds(train_sessions: DataFrame, n_folds: int, reserve: int, embargo: int) -> DataFrame:
    """fold, train_end, predict_start, predict_end, embargo_sessions.

    The last ``reserve`` sessions are cut into ``n_folds`` blocks whose sizes differ by
    at most one (larger blocks first); training stops ``embargo`` sessions before each.
    ``train_sessions`` has one row per session (column ``session``).
    """
    w = Window.orderBy("session")
    idx = stage(train_sessions.select("session", (F.row_number().over(w) - 1).alias("i")), "train-sessions")
    n = idx.count()
    if reserve >= n:
        raise ValueError(f"{reserve} reserved sessions leave nothing of the {n} to train on")
    if n - reserve <= embargo:
        raise ValueError(f"the first fold has no session left before an embargo of {embargo}")
    blocks = (
        idx.where(F.col("i") >= n - reserve)
        .withColumn("fold", F.ntile(n_folds).over(w))
        .groupBy("fold")
        .agg(F.min("session").alias("predict_start"), F.max("session").alias("predict_end"),
             F.min("i").alias("first_i"))
    )
    prior = idx.select(F.col("session").alias("s"), F.col("i").alias("j"))
    return (
        blocks.join(prior, (F.col("j") < F.col("first_i")) & (F.col("j") >= F.col("first_i") - embargo - 1))
        .groupBy("fold", "predict_start", "predict_end")
        .agg(F.min("s").alias("train_end"),
             F.array_remove(F.sort_array(F.collect_list("s")), F.min("s")).alias("embargo_sessions"))
        .select("fold", "train_end", "predict_start", "predict_end", "embargo_sessions")
    )


def fold_membership(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """(row, fold, role) for every fold a row takes part in.

    ``folds`` has a handful of rows (the fold count is a parameter), hence the broadcast.
    """
    f = F.broadcast(folds.select("fold", "train_end", "predict_start", "predict_end"))
    d = F.col("pred_date")
    inside = (d <= F.col("train_end")) | d.between(F.col("predict_start"), F.col("predict_end"))
    return panel.join(f, inside).withColumn(
        "role", F.when(d <= F.col("train_end"), "train").otherwise("predict"))


def fold_violations(sessions: DataFrame, folds: DataFrame, embargo: int) -> DataFrame:
    """Folds that overlap their own training window or leave fewer than ``embargo`` sessions between."""
    f = F.broadcast(folds.select("fold", "train_end", "predict_start", "predict_end"))
    d = F.col("session")
    both = (d <= F.col("train_end")) & d.between(F.col("predict_start"), F.col("predict_end"))
    gap = (d > F.col("train_end")) & (d < F.col("predict_start"))
    return (
        sessions.crossJoin(f).groupBy("fold")
        .agg(F.count_if(both).alias("overlap_sessions"), F.count_if(gap).alias("gap_sessions"))
        .where((F.col("overlap_sessions") > 0) | (F.col("gap_sessions") < embargo))
    )


def chronological_cut(df: DataFrame, fraction: float = 0.8, date_col: str = "pred_date") -> DataFrame:
    """Row-weighted, linearly interpolated date quantile as one row (cut).

    Rows are first counted per date, so the quantile runs over the calendar only.
    """
    days = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(date_col)
    run = days.select(
        (F.unix_date(date_col) * 86400.0).alias("sec"),
        F.sum("n").over(w).alias("upto"), "n",
        F.sum("n").over(Window.partitionBy()).alias("total"))
    at = F.lit(fraction) * (F.col("total") - 1)
    first = F.col("upto") - F.col("n")
    value = lambda k: F.max(F.when((first <= k) & (k < F.col("upto")), F.col("sec")))
    lo, hi = F.floor(at), F.least(F.floor(at) + 1, F.col("total") - 1)
    return run.agg(value(lo).alias("a"), value(hi).alias("b"), F.max(at - lo).alias("f")).select(
        (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
            secs=(F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).cast("decimal(18,6)"))).alias("cut"))


def split_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pred_date").alias("sessions"),
        F.count_distinct("symbol").alias("symbols"),
        F.min("pred_date").alias("first_date"), F.max("pred_date").alias("last_date"))
