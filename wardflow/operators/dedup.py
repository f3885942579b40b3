"""De-duplication, latest rows and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pick(df: DataFrame, keys: list[str], order: list[str], best) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    row = best(F.struct(*rest), rank).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per business key in ingest order; NULL keys form one group.

    An aggregate rather than a window: copies of a hot key collapse to one row per input
    partition before the shuffle, so no task ever sorts all copies of a key.
    """
    return _pick(df, keys, order, F.min_by)


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key (the row_number() = 1 pattern as a partial aggregate)."""
    return _pick(df, keys, order, F.max_by)


def distinct_pairs(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_or_empty(spark: SparkSession, frames: list[DataFrame], schema: T.StructType) -> DataFrame:
    """Union of frames, or an empty frame with the declared schema when there are none."""
    return union_all([spark.createDataFrame([], schema), *frames])
