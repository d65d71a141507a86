"""Line deduplication over the suffixes of line-ID sequences.

A document is the sequence of its lines.  Distributed prefix doubling names the runs of 2^j lines that start at each
line: a run's name is the earliest suffix, as (document, line), that begins with the same 2^j lines, and the next level
pairs the names of two neighbouring runs.  The suffixes with one name are an interval of the suffix array whose longest
common prefix is 2^j lines or more; suffixes alone in their interval repeat nothing and leave the table, so each level
is smaller than the one before.  A run of any length is named by the two overlapping power-of-two runs that cover it.

A line is deleted if it lies in a run of whole lines, at least ``min_chars`` code points long with the line ends
between them, that also starts earlier (smaller id, or earlier in the same document).  For each line two runs decide
that: the shortest long enough one that starts with it and the shortest one that ends with it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Keyed, fresh, stage, texts_of, with_length

MIN_CHARS = 30
LINES = "doc long, pos int, h1 long, h2 long, run_end int, run_start int"


def line_ids(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line: a 128-bit ID of its text, the last line of the shortest run from it that is long enough (-1:
    none) and the first line of the shortest such run that ends with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                lines = text.split("\n")
                reach = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
                before = np.r_[0, reach[:-1]]
                end = np.searchsorted(reach, before + min_chars + 1)
                start = np.searchsorted(before, reach - min_chars - 1, side="right") - 1
                ids = np.frombuffer(b"".join(xxh3_128_digest(x.encode()) for x in lines), "<i8").reshape(-1, 2)
                out.append((np.full(len(lines), key), np.arange(len(lines)), ids[:, 0], ids[:, 1],
                            np.where(end < len(lines), end, -1), start))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c), k) for c, k in zip(zip(*out), kinds)],
                    names=["doc", "pos", "h1", "h2", "run_end", "run_start"])

    return docs.select("doc", "text").mapInArrow(run, LINES)


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Groups of ``key`` with several rows: the key and the earliest (doc, pos) as ``first``."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first")).filter(
        "n > 1").drop("n")


def prefix_doubling(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(level-0 rows with all columns of ``lines`` and their name, names of all levels as (doc, pos, level, first))."""
    level0 = stage(lines.join(repeated(lines, ["h1", "h2"]), ["h1", "h2"]), "line-names")
    names = [level0.select("doc", "pos", F.lit(0).alias("level"), "first")]
    while not names[-1].isEmpty():
        now = names[-1].select("doc", "pos", F.col("first").alias("head"))
        half = 1 << len(names) - 1
        tail = now.select("doc", (F.col("pos") - half).alias("pos"), F.col("head").alias("tail"))
        pairs = now.join(tail, ["doc", "pos"])
        named = pairs.join(repeated(pairs, ["head", "tail"]), ["head", "tail"])
        names.append(stage(named.select("doc", "pos", F.lit(len(names)).alias("level"), "first"), "line-names"))
    every = names[0]
    for level in names[1:-1]:
        every = every.union(level)
    return level0, every


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, pos, end): runs of lines pos..end (inclusive) that also start earlier; their union is what goes."""
    level0, names = prefix_doubling(line_ids(docs, min_chars))
    runs = level0.filter("run_end >= 0").select("doc", "pos", F.col("run_end").alias("end")).union(
        level0.filter("run_start >= 0").select("doc", F.col("run_start").alias("pos"), F.col("pos").alias("end"))).distinct()
    lines = F.col("end") - F.col("pos") + 1
    runs = runs.withColumn("level", F.floor(F.log2(lines.cast("double"))).cast("int")).withColumn(
        "right", F.expr("end - shiftleft(1, level) + 1"))
    left = names.select("doc", "pos", "level", F.col("first").alias("head"))
    right = names.select("doc", F.col("pos").alias("right"), "level", F.col("first").alias("tail"))
    named = runs.join(left, ["doc", "pos", "level"]).join(right, ["doc", "right", "level"]).select(
        "doc", "pos", "end", "head", "tail", lines.alias("lines"))
    named = stage(named, "line-runs")
    key = ["head", "tail", "lines"]
    return named.join(repeated(named, key), key).filter(F.struct("doc", "pos") > F.col("first")).select("doc", "pos", "end")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed array<int>) of every id: the text without the deleted lines.

    Lines are split at \\n and compared as they are.  A null text stays null and has no line; an empty text is one
    empty line.  A text of which all lines go is empty.  Rows that share an id stay apart, in the order of
    ``Keyed``; a null id is the earliest; further columns are not read; an empty table gives no row.
    """
    keyed = Keyed(docs)
    rows = keyed.texts
    runs = repeated_runs(rows.filter("text is not null"), min_chars)
    gone = runs.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", "end"))))).alias("removed"))
    lines = F.split("text", "\n", -1)
    joined = rows.join(gone, "doc", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return keyed.with_ids(joined.select(
        "doc", without_lines("text", "removed").alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        "removed"), doc="doc_id")


def without_lines(text: str, removed: str):
    @F.pandas_udf("string")
    def cut(text: pd.Series, removed: pd.Series) -> pd.Series:
        def one(t, gone):
            if t is None or gone is None or not len(gone):
                return t
            gone = set(gone.tolist())
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        return pd.Series([one(t, g) for t, g in zip(text, removed)])

    return F.when(F.size(removed) > 0, cut(text, removed)).otherwise(F.col(text))


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the deleted lines cut from ``text`` and ``n_chars`` brought up to date; rows and columns stay."""
    rows = Keyed(docs)
    runs = repeated_runs(rows.texts.filter("text is not null"), min_chars)
    removed = fresh(docs.columns, "removed")
    gone = runs.groupBy(F.col("doc").alias(rows.key)).agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("pos", "end")))).alias(removed))
    joined = rows.table.join(gone, rows.key, "left").withColumn("text", without_lines("text", removed))
    return with_length(joined.select(*docs.columns))
