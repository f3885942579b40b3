"""Latest-snapshot, trailing-window and as-of operators.

The reference point is a scalar subquery: one partial aggregate over a single column whose value
is pushed into the scan as a filter. No join, no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, col: str = "date_key") -> Column:
    return df.select(F.max(col)).scalar()


def at_latest(df: DataFrame, col: str = "date_key") -> DataFrame:
    return df.filter(F.col(col) == latest(df, col))


def trailing_days(df: DataFrame, days: int, col: str = "date_key") -> DataFrame:
    """Rows from `days` before the newest date on, both ends included (days + 1 dates)."""
    return df.filter(F.col(col) >= F.date_sub(latest(df, col), days))


def trailing_minutes(df: DataFrame, minutes: int, col: str = "minute_ts") -> DataFrame:
    """Like trailing_days on the time of the data, not of the clock."""
    if not 1 <= minutes <= 1440:
        raise ValueError("minutes must be between 1 and 1440")
    return df.filter(F.col(col) >= latest(df, col) - F.make_dt_interval(mins=F.lit(minutes)))


def as_of(df: DataFrame, keys: list[str], value: str, order: str, cutoff: Column) -> DataFrame:
    """Value of the newest row at or before the cutoff, per key.

    max_by is a partial aggregate, so the history of a hot key is never gathered or sorted.
    """
    return df.filter(F.col(order) <= cutoff).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def split_holdout(df: DataFrame, days: int, col: str = "date_key") -> tuple[DataFrame, DataFrame]:
    """(train, hold-out): everything up to `days` before the newest date, and the rest."""
    cutoff = F.date_sub(latest(df, col), days)
    return df.filter(F.col(col) <= cutoff), df.filter(F.col(col) > cutoff)


def newest_first(df: DataFrame, n: int, col: str = "date_key", ascending: bool = True) -> DataFrame:
    """Newest n rows, then in ascending order."""
    top = df.orderBy(F.desc(col)).limit(n)
    return top.orderBy(col) if ascending else top


def top(df: DataFrame, n: int, by: str, tie: list[str]) -> DataFrame:
    """Top n by a value, NULLs last, with a unique tie-break."""
    return df.orderBy(F.desc_nulls_last(by), *tie).limit(n)
