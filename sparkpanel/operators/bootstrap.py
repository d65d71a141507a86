"""Paired bootstrap over contiguous blocks of sessions.

Scores that are ratios of sums are resampled from one row of sums per block, so no data
row is ever copied.  The Spearman score is not a ratio of sums; there each row carries
its per-block counts of smaller values, from which the average rank in any resample
follows by one dot product with the block multiplicities.  Draws come from a hash of
(seed, draw, slot) and are the same for every partitioning.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import hash_bucket, ratio
from ..sources.staging import stage
from .metrics import common_rows
from .ranking import join_by_value

#: Rows and draws of one matrix product.
CHUNK, DRAW_CHUNK = 1024, 256


def session_blocks(df: DataFrame, block_sessions: int) -> DataFrame:
    """pred_date, block: consecutive runs of ``block_sessions`` sessions (one row per session)."""
    w = Window.orderBy("pred_date")
    days = df.select("pred_date").distinct()
    return days.withColumn("block", F.floor((F.row_number().over(w) - 1) / block_sessions).cast("int"))


@dataclass(frozen=True)
class Comparison:
    """Two scores that are ratios of sums with one denominator; the interval is that of their difference.

    Rows that do not meet ``where`` count nowhere; sessions without other rows are in no block.  ``seed`` may be an
    expression over the group.
    """
    name: str
    first: Column
    second: Column
    den: Column
    seed: int | Column
    where: Column | None = None

    @staticmethod
    def of_direction(name: str, a: Column, b: Column, target: Column, seed: int | Column, where: Column | None = None) -> Comparison:
        """Direction scores of two direction forecasts."""
        return Comparison(name, a * target, b * target, F.abs(target), seed, where)

    @staticmethod
    def of_magnitude(name: str, a: Column, b: Column, actual: Column, seed: int | Column, where: Column | None = None) -> Comparison:
        """Magnitude scores of two magnitude forecasts, one minus the error share each."""
        return Comparison(name, F.abs(b - actual), F.abs(a - actual), actual, seed, where)


def ratio_intervals(df: DataFrame, groups: list[str], comparisons: list[Comparison], block_sessions: int = 5,
                    draws: int = 2000) -> DataFrame:
    """(groups, comparison, mean, ci_low, ci_high): all comparisons in all groups from one scan of the rows.

    The rows become sums per session, these one table of blocks.  Draws are dealt by (group, comparison, draw), so
    the sums of a draw need no further shuffle.
    """
    sums = ("first", "second", "den")
    kept = lambda c, x: x if c.where is None else F.when(c.where, x)
    days = df.groupBy(*groups, "pred_date").agg(*[
        e for k, c in enumerate(comparisons) for e in (
            *[F.sum(kept(c, getattr(c, s)).cast("double")).alias(f"_{s}{k}") for s in sums],
            F.count(kept(c, F.lit(1))).alias(f"_rows{k}"))])
    entries = F.array(*[
        F.struct(F.lit(c.name).alias("comparison"), (c.seed if isinstance(c.seed, Column) else F.lit(c.seed)).alias("seed"),
                 *[F.col(f"_{s}{k}").alias(s) for s in sums], F.col(f"_rows{k}").alias("rows"))
        for k, c in enumerate(comparisons)])
    keys = [*groups, "comparison"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("pred_date"))
    days = days.select(*groups, "pred_date", F.explode(entries).alias("_e")).select(*groups, "pred_date", "_e.*").where(
        "rows > 0").withColumn("block", F.floor((number - 1) / block_sessions))
    blocks = stage(days.groupBy(*keys, "seed", "block").agg(*[F.sum(s).alias(s) for s in sums]), "blocks")
    drawn = blocks.groupBy(*keys, "seed").agg((F.max("block") + 1).alias("_n")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).repartition(*keys, "draw")
    picks = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("slot")).select(
        *keys, "draw", hash_bucket(F.col("seed"), F.col("_n"), "draw", "slot").alias("block"))
    total = picks.join(blocks.drop("seed"), [*keys, "block"]).groupBy(*keys, "draw").agg(*[F.sum(s).alias(s) for s in sums])
    return _interval(total.select(*keys, (ratio("first", "den") - ratio("second", "den")).alias("diff")), keys)


def _interval(diffs: DataFrame, groups: list[str] | tuple[()] = ()) -> DataFrame:
    """Mean and central 95 % interval of each group; one row per draw goes in."""
    q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
    return diffs.groupBy(*groups).agg(F.avg("diff").alias("mean"), q.alias("_q")).select(
        *groups, "mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def direction_diff(df: DataFrame, a: Column, b: Column, target: Column, seed: int = 42, **kw) -> DataFrame:
    """Difference of the direction scores of two direction forecasts: one row."""
    return ratio_intervals(df, [], [Comparison.of_direction("diff", a, b, target, seed)], **kw).drop("comparison")


def magnitude_diff(df: DataFrame, a: Column, b: Column, actual: Column, seed: int = 42, **kw) -> DataFrame:
    """Difference of the magnitude scores of two magnitude forecasts: one row."""
    return ratio_intervals(df, [], [Comparison.of_magnitude("diff", a, b, actual, seed)], **kw).drop("comparison")


def _multiplicities(n_blocks: int, draws: int, seed: int) -> np.ndarray:
    """(block, draw) matrix of how often a block is drawn; its size is set by the parameters."""
    counts = np.zeros((n_blocks, draws), np.int32)
    for draw in range(draws):
        for slot in range(n_blocks):
            digest = hashlib.md5(f"{seed}|{draw}|{slot}".encode()).hexdigest()
            counts[int(digest[:8], 16) % n_blocks, draw] += 1
    return counts


def _block_counts_below(long: DataFrame, n_blocks: int) -> DataFrame:
    """(var, value, n, below): per block twice the number of smaller values plus the number of equal ones.

    Rows are first reduced to one per (var, value, block), so a hot value is at most one row per block.  These are dealt out by
    range of the value, each value whole in one slice.  A slice starts from its blocks' totals in all slices before it: a running
    sum over one row per (slice, block), so what is kept beside the values grows with slices x blocks alone.
    """
    cells = long.groupBy("var", "value", "block").agg(F.count(F.lit(1)).alias("n"))
    sliced = stage(cells.repartitionByRange("var", "value").withColumn("_slice", F.spark_partition_id()), "slices")
    totals = sliced.groupBy("var", "block", "_slice").agg(F.sum("n").alias("n"))
    slices = F.array_sort(F.collect_set("_slice").over(Window.partitionBy("var")))
    # every slice of the variable for every block, those without the block with 0
    grid = totals.withColumn("_all", slices).groupBy("var", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("_slice", "n"))).alias("at"), F.first("_all").alias("_all")).select(
        "var", "block", "at", F.explode("_all").alias("_slice")).select(
        "var", "block", "_slice", F.coalesce(F.try_element_at("at", F.col("_slice")), F.lit(0)).alias("n"))
    before = Window.partitionBy("var", "block").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = grid.withColumn("n", F.sum("n").over(before)).where("n > 0").groupBy("var", "_slice").agg(
        F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("start"))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by value within a slice; a value may go over the end of a batch."""
        slice_, running, value, here, out = None, None, None, None, []

        def told() -> pd.DataFrame:
            names, values, sizes, below = zip(*out)
            out.clear()
            return pd.DataFrame({"var": names, "value": values, "n": sizes, "below": list(below)})

        def closed() -> None:
            nonlocal running
            out.append((slice_[0], value, int(here.sum()), (2 * running + here).tolist()))
            running = running + here

        for batch in batches:
            for var, number, v, block, n, first in zip(*(batch[c] for c in ("var", "_slice", "value", "block", "n", "start"))):
                if (var, number) != slice_ or v != value:
                    if slice_ is not None:
                        closed()
                    if (var, number) != slice_:
                        slice_, running = (var, number), np.zeros(n_blocks, np.int64)
                        for k, x in (first or {}).items():
                            running[k] = x
                    value, here = v, np.zeros(n_blocks, np.int64)
                here[block] += n
            if len(out) > 1024:
                yield told()
        if slice_ is not None:
            closed()
        if out:
            yield told()

    keyed = sliced.join(start, ["var", "_slice"], "left").select("var", "_slice", "value", "block", "n", "start")
    return keyed.repartition("var", "_slice").sortWithinPartitions("var", "_slice", "value").mapInPandas(
        counts, "var string, value double, n bigint, below array<bigint>")


def spearman_diff(df: DataFrame, a: str, b: str, outcome: str, row_keys: list[str], block_sessions: int = 5,
                  draws: int = 2000, seed: int = 42) -> DataFrame:
    """Difference of two Spearman scores against the same outcome.

    A row's average rank in a resample is the product of its block counts with the blocks' multiplicities.  Ranks of a
    batch of rows in a batch of draws are one matrix product; rows are never copied per draw, and what is sent
    per row grows with the blocks, which are fewer than the draws.
    """
    blocks = stage(session_blocks(df, block_sessions), "session-blocks")
    n_blocks = blocks.count() and blocks.agg(F.max("block")).first()[0] + 1
    cols = {"a": a, "b": b, "y": outcome}
    rows = df.select(*row_keys, *[c for c in ("pred_date",) if c not in row_keys],
                     *[F.col(c).cast("double").alias(f"_{v}") for v, c in cols.items()]).join(blocks, "pred_date")
    rows = stage(rows.where("_a is not null and _b is not null and _y is not null"), "bootstrap-rows")
    long = rows.select("block", F.explode(F.array(*[
        F.struct(F.lit(v).alias("var"), F.col(f"_{v}").alias("value")) for v in cols])).alias("e")).select("block", "e.*")
    below = stage(_block_counts_below(long, n_blocks), "below")
    # rows with the same values in the same block count together
    wide = rows.groupBy("block", *[f"_{v}" for v in cols]).agg(F.count(F.lit(1)).alias("n_rows"))
    for v in cols:
        table = below.where(F.col("var") == v).select(F.col("value").alias(f"_{v}"), "n", F.col("below").alias(f"below_{v}"))
        wide = join_by_value(wide, table, [f"_{v}"])
    size = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    times = _multiplicities(n_blocks, draws, seed)
    # twice the mean rank less a half, in units of half a rank
    center = np.array([size.get(k, 0) for k in range(n_blocks)], np.int64) @ times.astype(np.int64)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, draws))
        for batch in batches:
            for lo in range(0, len(batch), CHUNK):
                part = batch.iloc[lo:lo + CHUNK]
                at, n_rows = part["block"].to_numpy(), part["n_rows"].to_numpy(float)
                counts = [np.stack(part[f"below_{v}"].to_numpy()).astype(float) for v in "aby"]
                for first in range(0, draws, DRAW_CHUNK):
                    drawn = slice(first, first + DRAW_CHUNK)
                    m = times[:, drawn].astype(float)
                    ra, rb, ry = ((c @ m - center[drawn]) / 2 for c in counts)
                    weight = m[at] * n_rows[:, None]
                    for k, (x, z) in enumerate(((ra, ry), (rb, ry), (ra, ra), (rb, rb), (ry, ry))):
                        total[k, drawn] += np.einsum("ij,ij,ij->j", weight, x, z)
        yield pd.DataFrame({"draw": np.arange(draws), "ay": total[0], "by": total[1], "aa": total[2],
                            "bb": total[3], "yy": total[4]})

    sums = ["ay", "by", "aa", "bb", "yy"]
    parts = wide.select("block", "n_rows", "below_a", "below_b", "below_y").mapInPandas(
        moments, "draw int, " + ", ".join(f"{s} double" for s in sums))
    drawn = parts.groupBy("draw").agg(*[F.sum(s).alias(s) for s in sums])
    corr = lambda num, d1, d2: ratio(num, F.sqrt(F.col(d1) * F.col(d2)))
    return _interval(drawn.select((corr("ay", "aa", "yy") - corr("by", "bb", "yy")).alias("diff")).where(
        "diff is not null"))


def comparison_table(df: DataFrame, splits: tuple[str, ...] = ("valid", "test"), block_sessions: int = 5,
                     draws: int = 2000, seed: int = 42, with_spearman: bool = True) -> DataFrame:
    """The uncertainty table: every standard comparison on every split, each with its own seed.

    ``with_spearman`` adds the confidence against the negative magnitude, both as Spearman scores against small errors.
    """
    kw = dict(block_sessions=block_sessions, draws=draws)
    d, a, m = F.col("pred_direction"), F.col("actual_return_pct"), F.col("pred_magnitude_pct")
    base = F.element_at(F.create_map(*[
        F.lit(x) for i, split in enumerate(splits) for x in (split, seed + 10 * i)]), F.col("split"))
    out = ratio_intervals(df.where(F.col("split").isin(*splits)), ["split"], [
        Comparison.of_direction("residual_vs_zero", d, F.lit(0.0), a - F.col("universe_mean_pct"), base),
        Comparison.of_direction("pooled_vs_always_up", d, F.lit(1.0), a, base + 1),
        Comparison.of_magnitude("magnitude_vs_trailing", m, F.col("vol_baseline_20"), F.col("actual_magnitude_pct"),
                                base + 2, F.col("vol_baseline_20").isNotNull()),
    ], **kw)
    for i, split in enumerate(splits if with_spearman else ()):
        scored = df.where(F.col("split") == split).withColumns({
            "_neg_m": -m, "_neg_err": -F.abs(m - F.col("actual_magnitude_pct"))})
        result = spearman_diff(
            scored, "conf_magnitude", "_neg_m", "_neg_err", ["pred_date", "symbol"], seed=seed + 10 * i + 3, **kw)
        out = out.unionByName(result.select(
            F.lit(split).alias("split"), F.lit("confidence_vs_neg_magnitude").alias("comparison"), "*"))
    return out


def system_intervals(a: DataFrame, b: DataFrame, block_sessions: int = 5, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(comparison, mean, ci_low, ci_high): direction of one system against another on their common rows, pooled and residual."""
    keys = ["pred_date", "symbol"]
    first, second = common_rows(a, b)
    rows = first.join(second.select(*keys, F.col("pred_direction").alias("_rival")), keys)
    d, rival, target = F.col("pred_direction"), F.col("_rival"), F.col("actual_return_pct")
    return ratio_intervals(rows, [], [
        Comparison.of_direction("pooled", d, rival, target, seed),
        Comparison.of_direction("residual", d, rival, target - F.col("universe_mean_pct"), seed),
    ], block_sessions=block_sessions, draws=draws)
