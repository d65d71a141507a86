"""Exact ranks, positions, quantiles and empirical CDFs of groups of any size.

Everything rests on one step: the weight of strictly smaller values inside a group.
The input is first reduced to one row per distinct (group, value), so a value that
occurs in a third of all rows is a single row from there on.  The histogram is
range-partitioned, each slice sums locally, and slice totals (one row per group and
slice) supply the offset, so no task ever holds a whole group, whatever its size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage


def running_weight(hist: DataFrame, groups: list[str], value: str, weight: str = "n", out: str = "below",
                   total: str | None = None) -> DataFrame:
    """Add the summed ``weight`` of strictly smaller ``value`` rows of the same group.

    ``hist`` must have one row per (groups, value); it is evaluated for the range bounds and for the slices, which are
    written once.  With ``total`` the weight of the whole group is added as well.
    """
    before = (Window.unboundedPreceding, -1)
    sliced = stage(
        hist.repartitionByRange(*groups, value).withColumn("_slice", F.spark_partition_id()), "slices")
    local = Window.partitionBy(*groups, "_slice").orderBy(value).rowsBetween(*before)
    across = Window.partitionBy(*groups).orderBy("_slice")
    offsets = sliced.groupBy(*groups, "_slice").agg(F.sum(weight).alias("_w")).select(
        *groups, "_slice", F.coalesce(F.sum("_w").over(across.rowsBetween(*before)), F.lit(0)).alias("_offset"),
        *([F.sum("_w").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)]
          if total else []))
    return (
        sliced.withColumn("_local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
        .join(offsets, [*groups, "_slice"])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_slice")
    )


def value_histogram(df: DataFrame, groups: list[str], value: str | Column, name: str = "value") -> DataFrame:
    """(groups, value, n) without missing values."""
    value = F.col(value) if isinstance(value, str) else value
    hist = df.select(*groups, value.alias(name)).where(F.col(name).isNotNull())
    return hist.groupBy(*groups, name).agg(F.count(F.lit(1)).alias("n"))


def join_by_value(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on value keys where ``table`` has unique keys and their row count ``n``.

    A value that very many rows share makes a large partition on the left side only; adaptive execution splits it.
    """
    return df.join(table.drop("n"), keys, "left")


def average_ranks(df: DataFrame, groups: list[str], columns: list[str], row_keys: list[str],
                  prefix: str = "rank_", count_prefix: str | None = None, percent: bool = False) -> DataFrame:
    """Add the 1-based average-tie rank of each column within its group; missing stays missing.

    All columns are ranked in one pass over the long (group, column, value) form.
    ``row_keys`` identify a row.  With ``percent`` ranks are divided by the number of
    non-missing values of the group, with ``count_prefix`` that number is added.
    """
    long = df.select(
        *row_keys, *[g for g in groups if g not in row_keys],
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns
        ])).alias("_e"),
    ).select("*", "_e._c", "_e._v").drop("_e").where(F.col("_v").isNotNull())
    keys = [*groups, "_c"]
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    ranked = running_weight(value_histogram(long, keys, "_v", "_v"), keys, "_v", total="_t").select(
        *keys, "_v", "n", (rank / F.col("_t") if percent else rank).alias("_r"))
    ranks = join_by_value(long, ranked, [*keys, "_v"])
    wide = ranks.groupBy(*row_keys).agg(
        *[F.max(F.when(F.col("_c") == c, F.col("_r"))).alias(f"{prefix}{c}") for c in columns])
    out = df.join(wide, row_keys, "left")
    if count_prefix is not None:
        sizes = stage(df.groupBy(*groups).agg(*[F.count(c).alias(f"{count_prefix}{c}") for c in columns]), "sizes")
        out = out.join(sizes, groups, "left") if groups else out.crossJoin(sizes)
    return out


def positions(df: DataFrame, groups: list[str], order: list[Column | str], row_keys: list[str],
              out: str = "position", total: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group under a unique ordering, with ``total`` the group's size too."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])
    table = df.select(*dict.fromkeys([*row_keys, *groups]), key.alias("_k"), F.lit(1).alias("n"))
    placed = running_weight(table, groups, "_k", out=out, total=total)
    return df.join(placed.select(
        *row_keys, F.col(out).cast("bigint").alias(out), *([total] if total else [])), row_keys, "left")


def quantiles(df: DataFrame, groups: list[str], value: str | Column, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles: one row (groups, prob, quantile) per group and prob.

    A value keeps only the probs whose lower or upper neighbour it is, two values at most for each of them.
    """
    below = running_weight(value_histogram(df, groups, value, "_v"), groups, "_v", total="_total")
    at = lambda p: p * (F.col("_total") - 1)
    low = lambda p: F.floor(at(p))
    high = lambda p: F.least(low(p) + 1, F.col("_total") - 1)
    inside = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    wanted = F.filter(F.array(*[F.lit(float(p)) for p in probs]), lambda p: inside(low(p)) | inside(high(p)))
    p = F.col("prob")
    return below.select("*", F.explode(wanted).alias("prob")).groupBy(*groups, "prob").agg(
        F.max(F.when(inside(low(p)), F.col("_v"))).alias("_a"),
        F.max(F.when(inside(high(p)), F.col("_v"))).alias("_b"),
        F.max(at(p) - low(p)).alias("_f"),
    ).select(*groups, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))


def decile_of(position: Column, size: Column, bins: int = 10) -> Column:
    """Bin 0..bins-1 of a 0-based position: equal-count bins with right-closed edges at k*(size-1)/bins."""
    last = size - 1
    upper = F.floor((position * bins + last - 1) / F.nullif(last, F.lit(0)))
    return (F.greatest(F.coalesce(upper, F.lit(1)), F.lit(1)) - 1).cast("int")
