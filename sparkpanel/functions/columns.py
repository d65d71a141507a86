"""Column helpers shared by all operators.  Missing values are SQL nulls throughout."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(c: str) -> Column:
    """The column of this very name; a dot in it does not ask for a field."""
    return F.col(f"`{c}`")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is zero or anything is missing."""
    return F.try_divide(col(a), col(b))


def pct_change(new: str | Column, old: str | Column) -> Column:
    return (ratio(new, old) - 1.0) * 100.0


def flag(cond: Column) -> Column:
    """1.0 / 0.0 indicator in which a missing comparison counts as false."""
    return F.when(cond, 1.0).otherwise(0.0)


def finite(c: str | Column) -> Column:
    """The value itself, or null when it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sign_up(c: str | Column) -> Column:
    """+1 for values >= 0 and -1 otherwise (a missing value is -1)."""
    return F.when(col(c) >= 0, 1.0).otherwise(-1.0)


def positive_log(c: str | Column) -> Column:
    c = col(c)
    return F.when(c > 0, F.ln(c))


def count_nulls(cols: list[str]) -> Column:
    """Number of missing values among ``cols`` in a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def hash_fraction(seed: int | str, *keys: str | Column) -> Column:
    """Uniform [0, 1) number that depends only on the seed and the keys.

    The first 32 bits of an md5 are the same in any SQL engine and for any
    partitioning, so resampling never depends on the row order.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_bucket(seed: int | str | Column, buckets: int | Column, *keys: str | Column) -> Column:
    """Uniform integer in [0, buckets) from the same hash."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", first, *[col(k).cast("string") for k in keys])
    n = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))
