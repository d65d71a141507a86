"""What the operators on embeddings share: sound vectors and Arrow list columns as matrices."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(vector: str) -> Column:
    """True where the vector is known and all its entries are finite numbers; never null."""
    # 0 * x is 0 for finite x only
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double") * 0.0))
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """The lists of a column as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if len(flat) == width * len(column) and (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), kind)
    out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)]).astype(int)] = flat
    return out


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large and very small entries neither overflow nor vanish."""
    top = np.abs(rows).max(1, keepdims=True) if rows.shape[1] else np.ones((len(rows), 1))
    scaled = rows / np.where(top > 0, top, 1)
    length = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return scaled / np.where(length > 0, length, 1)
