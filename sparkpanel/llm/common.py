"""What the text operators share: row keys, word splitting and intermediate tables."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkpanel.sources.staging import stage

__all__ = ["Keyed", "NULL_ID", "bytes_of", "documents", "fresh", "merge_intervals", "stage", "texts_of", "with_length", "WHITE"]

#: Key of the row whose id is null; it sorts before all other ids.
NULL_ID = -(1 << 63)
#: The white space of the word rule [^\x20\x09-\x0D]+.
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Keyed:
    """A table's rows under a key of their own, so that rows that share an id, or have none, stay apart.

    Where all ids are known and differ, which is checked on the id column alone, the key is the id as a long (NULL_ID for a
    single null).  Otherwise the rows are numbered in the order of their ids, nulls first: dealt out by range of
    (id, hash of the value), sorted, numbered by partition and written, so that a key stays with its row.  Keys are in the order of
    the ids either way; equal ids follow the hash of their value.

    ``table`` has all columns and the key under the name ``key``, which clashes with none; ``texts`` is (doc, text).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", value_col: str = "text"):
        self.columns, self.id_col, self.value_col = docs.columns, id_col, value_col
        self.key = fresh(docs.columns, "row_key")
        ids = F.col(id_col).cast("long")
        known = docs.select(F.coalesce(ids, F.lit(NULL_ID)).alias("doc"))
        self.unique = known.groupBy("doc").count().filter("count > 1").isEmpty()
        if self.unique:
            self.table = docs.withColumn(self.key, F.coalesce(ids, F.lit(NULL_ID)))
            return
        # the place in the input splits many copies of one row over several ranges
        place, mix = fresh(docs.columns, "row_place"), fresh(docs.columns, "row_mix")
        order = [ids.asc_nulls_first(), F.col(mix), F.col(place)]
        self.table = stage(docs.withColumns({mix: F.xxhash64(value_col), place: F.monotonically_increasing_id()})
                           .repartitionByRange(*order).sortWithinPartitions(*order)
                           .withColumn(self.key, F.monotonically_increasing_id()).drop(mix, place), "row-keys")

    @property
    def texts(self) -> DataFrame:
        return self.table.select(F.col(self.key).alias("doc"), F.col(self.value_col).alias("text"))

    def with_ids(self, rows: DataFrame, **names: str) -> DataFrame:
        """``rows`` with each key column replaced, in place, by its ids under the given name: ``with_ids(rows, doc="doc_id")``."""
        if self.unique:
            return rows.select(*[F.when(F.col(c) != NULL_ID, F.col(c)).alias(names[c]) if c in names else c for c in rows.columns])
        for key, name in names.items():
            ids = self.table.select(F.col(self.key).alias(key), F.col(self.id_col).cast("long").alias(f"{name} of key"))
            rows = rows.join(ids, key, "left")
        return rows.select(*[F.col(f"`{names[c]} of key`").alias(names[c]) if c in names else c for c in rows.columns
                             if not c.endswith(" of key")])


def with_length(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if there is such a column, brought up to date; a null text has a null length."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Each value's UTF-8 bytes as a view of the Arrow buffer; null as no bytes."""
    for value in column:
        buffer = value.as_buffer()
        yield np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)


def merge_intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as sorted, disjoint, non-touching intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(fresh)[1:] - 1, len(starts) - 1]
    return starts[fresh], reach[last]
