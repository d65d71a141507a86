"""Isotonic regression of any number of points, and piecewise linear curves on tables.

The fit pools adjacent violators: any order of poolings that ends without a violation gives the one solution.  Points
are dealt out by range of x; each slice pools its own and keeps a stack of blocks.  What then remains are violations between
neighbouring slices, which one row per slice shows.  In rounds, pairs of such neighbours hand the ends of their stacks that
face each other to a task of their own, which pools them into a new slice between the two.  The ends grow from round to
round, up to ``MOST`` blocks, so a long run that must be pooled takes few rounds, and no process ever holds all blocks.

The fitted curve is a table of knots; reading it off merges the knots with the distinct inputs by range, too.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .ranking import join_by_value

#: Blocks of a slice's end that meet the neighbour's, at first and at most.
ENDS, MOST = 1 << 12, 1 << 20
BLOCKS = "slice long, pos long, lo double, hi double, s double, w double"


def pooled(blocks: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Stack of blocks (lo, hi, sum, weight) with rising means; input is in order of lo."""
    stack: list[list[float]] = []
    for lo, hi, s, w in blocks:
        while stack and stack[-1][2] * w >= s * stack[-1][3]:
            lo, s, w = stack[-1][0], s + stack[-1][2], w + stack[-1][3]
            stack.pop()
        stack.append([lo, hi, s, w])
    return stack


def isotonic_blocks(points: DataFrame, ends: int = ENDS, most: int = MOST) -> DataFrame:
    """Staged (slice, pos, lo, hi, s, w): blocks of the increasing fit; ``points`` has one row (x, s, w) per x.

    ``s`` is the sum of the outcomes, ``w`` their number; a block's fitted value is s / w from lo to hi.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[float, float, float, float]]:
            for batch in batches:
                x, s, w = (c.to_pylist() for c in batch.columns)
                yield from zip(x, x, s, w)

        found = pooled(rows())
        here = TaskContext.get().partitionId()
        for at in range(0, len(found), 1 << 16):
            part = np.array(found[at:at + (1 << 16)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), here, np.int64)), pa.array(np.arange(at, at + len(part))), *map(pa.array, part.T)],
                names=["slice", "pos", "lo", "hi", "s", "w"])

    blocks = stage(points.select("x", "s", "w").repartitionByRange("x").sortWithinPartitions("x").mapInArrow(local, BLOCKS), "isotonic")
    edge = F.struct("lo", "s", "w")
    fresh = 1 << 40
    while True:
        slices = blocks.groupBy("slice").agg(
            F.min_by(edge, "pos").alias("first"), F.max_by(edge, "pos").alias("last"), F.min("pos").alias("low"), F.max("pos").alias("high"))
        # one row per slice
        order = sorted(slices.collect(), key=lambda r: r["first"].lo)
        zones, used = [], -1
        for k, (a, b) in enumerate(zip(order, order[1:])):
            if k > used and a["last"].s * b["first"].w >= b["first"].s * a["last"].w:
                zones += [(a.slice, a.high - ends + 1, a.high, fresh), (b.slice, b.low, b.low + ends - 1, fresh)]
                fresh, used = fresh + 1, k + 1
        if not zones:
            return blocks
        where = blocks.sparkSession.createDataFrame(zones, "slice long, start long, stop long, zone long")
        marked = blocks.join(F.broadcast(where), "slice", "left").withColumn(
            "zone", F.when(F.col("pos").between(F.col("start"), F.col("stop")), F.col("zone")))
        meeting = marked.where("zone is not null").groupBy("zone").applyInPandas(_pool_zone, BLOCKS)
        blocks = stage(marked.where("zone is null").select(*blocks.columns).unionByName(meeting), "isotonic")
        ends = min(4 * ends, most)


def _pool_zone(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo")
    found = np.array(pooled(zip(rows["lo"], rows["hi"], rows["s"], rows["w"])))
    return pd.DataFrame({"slice": rows["zone"].iloc[0], "pos": np.arange(len(found)), "lo": found[:, 0], "hi": found[:, 1],
                         "s": found[:, 2], "w": found[:, 3]})


def isotonic_knots(rows: DataFrame, x: str, y: str, ends: int = ENDS, most: int = MOST) -> DataFrame:
    """Staged (x, value) knots of the increasing fit of ``y`` on ``x``; rows without either are left out."""
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(
        F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
    value = F.col("s") / F.col("w")
    corners = F.array_distinct(F.array("lo", "hi"))
    return stage(isotonic_blocks(points, ends, most).select(F.explode(corners).alias("x"), value.alias("value")), "isotonic-knots")


def read_curve(df: DataFrame, x: str | Column, knots: DataFrame, out: str) -> DataFrame:
    """Add the curve's value at ``x``: linear between knots, constant beyond them, missing for a missing ``x``.

    Knots and distinct inputs are dealt out by range together; a slice's outer neighbours come from a table of one row
    per slice.
    """
    at = (F.col(x) if isinstance(x, str) else x).cast("double")
    rows = df.withColumn("_at", at)
    both = rows.select("_at", F.lit(None).cast("double").alias("value")).where("_at is not null").unionByName(
        knots.select(F.col("x").alias("_at"), "value")).groupBy("_at").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    sliced = stage(both.repartitionByRange("_at").withColumn("_slice", F.spark_partition_id()), "curve")
    knot = F.when(F.col("value").isNotNull(), F.struct(F.col("_at").alias("x"), "value"))
    # a frame that ends with the group is summed anew for every row, so neighbours above are looked up in falling order
    across, back = Window.orderBy("_slice"), Window.orderBy(F.desc("_slice"))
    outer = sliced.groupBy("_slice").agg(F.max_by(knot, F.when(F.col("value").isNotNull(), F.col("_at"))).alias("last"),
                                         F.min_by(knot, F.when(F.col("value").isNotNull(), F.col("_at"))).alias("first"))
    outer = outer.select(
        "_slice", F.last("last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("first", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    inside, falling = Window.partitionBy("_slice").orderBy("_at"), Window.partitionBy("_slice").orderBy(F.desc("_at"))
    found = sliced.join(outer, "_slice").select(
        "_at", "n", F.coalesce(F.last(knot, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_before").alias("a"),
        F.coalesce(F.last(knot, True).over(falling.rowsBetween(Window.unboundedPreceding, 0)), "_after").alias("b"))
    share = F.try_divide(F.col("_at") - F.col("a.x"), F.col("b.x") - F.col("a.x"))
    value = F.when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a.value") == F.col("b.value")), F.col("a.value")).otherwise(
        F.col("a.value") + (F.col("b.value") - F.col("a.value")) * share)
    return join_by_value(rows, found.select("_at", "n", value.alias(out)), ["_at"]).select(
        *[c for c in df.columns if c != out], out)


def fit_isotonic(train: DataFrame, x: str, y: str) -> Callable[[DataFrame, str], DataFrame]:
    """Monotone fit with linear interpolation, constant beyond the training range."""
    knots = isotonic_knots(train, x, y)
    return lambda df, out: read_curve(df, x, knots, out)
