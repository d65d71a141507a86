"""Named queries over the given tables, one per operator."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same query for DuckDB over the same tables."""
    def register(fn: Query) -> Query:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = (), **special: int) -> DataFrame:
    """Round double columns (but ``keep``), so that two engines agree despite their summation order."""
    return df.select(*[
        F.round(f.name, special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, DoubleType) and f.name not in keep else F.col(f.name) for f in df.schema])


def as_long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})
