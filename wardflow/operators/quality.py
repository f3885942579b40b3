"""Completeness and integrity checks. Each returns rows (check, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.col("violations").cast("long").alias("violations"))


def not_null(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return _named(df.agg(F.count_if(bad).alias("violations")), name)


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of key values that occur more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _named(many.agg(F.count(F.lit(1)).alias("violations")), name)


def foreign_key(df: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys without a dimension row. Distinct first, so a hot key is joined once."""
    orphans = df.select(key).distinct().join(dim.select(key), key, "left_anti")
    return _named(orphans.agg(F.count(F.lit(1)).alias("violations")), name)


def gap_free(dim: DataFrame, name: str, day: str = "date_key") -> DataFrame:
    """Days missing between the first and the last date."""
    span = F.datediff(F.max(day), F.min(day)) + 1
    return _named(dim.agg(F.coalesce(span - F.count_distinct(day), F.lit(0)).alias("violations")), name)


def not_empty(df: DataFrame, name: str) -> DataFrame:
    return _named(df.limit(1).agg((F.lit(1) - F.count(F.lit(1))).alias("violations")), name)


def one_to_one(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Keys with several values, which would fan out a join."""
    many = df.select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _named(many.agg(F.count_if(F.col("n") > 1).alias("violations")), name)


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def reconcile(parts: DataFrame, total: DataFrame, count: str, name: str = "events lost") -> DataFrame:
    """Difference between a row count and the sum of an aggregate built from the same rows."""
    summed = parts.select(F.coalesce(F.sum(count), F.lit(0))).scalar()
    return _named(total.agg((F.count(F.lit(1)) - summed).alias("violations")), name)
