"""Tables that lie as joins and windows need them: by the hash of their keys, sorted inside a bucket.

Tables with the same keys and number of buckets are joined, grouped and windowed by these keys (and
further ones) without moving a row. The layout is paid for once, when the table is written. All rows of a
key lie in one bucket, so the keys should be series, not something a third of the rows share.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .layers import new_path

#: Bytes of a bucket, about.
BUCKET_BYTES = 256 << 20
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def bucket_count(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """From the planner's size of a frame; powers of two, so that tables can share a number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << (size // bucket_bytes).bit_length()


def save_bucketed(
    df: DataFrame, name: str, keys: list[str], buckets: int, order: list[str] | None = None, path: str | None = None
) -> DataFrame:
    """Replace a catalog table by the rows, bucketed by `keys` and sorted by these and `order`.

    Rows are moved to their bucket first, so that each bucket is one file.
    """
    spark = df.sparkSession
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
    writer = writer.option("path", path or new_path(spark, name)).bucketBy(buckets, *keys)
    writer.sortBy(*keys, *(order or [])).saveAsTable(name)
    return spark.table(name)


@contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside may use buckets by some of their keys only."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


def shuffles(df: DataFrame) -> int:
    """Exchanges of rows in a frame's physical plan, broadcasts aside."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "BroadcastExchange" not in line for line in plan.splitlines())
