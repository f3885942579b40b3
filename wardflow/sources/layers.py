"""Stored intermediate layers in the folder the cluster shares for checkpoints.

A frame that several later steps read is written once as parquet and read back. Unlike a cached
frame it survives the loss of executors, and unlike a checkpointed one it keeps column pruning,
filter push-down and true file sizes, which the planner uses to choose broadcast joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir, on every master alike."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/wardflow/{uuid.uuid4().hex}/{label}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes a frame reads of which the size is not known, such as rows of an RDD, are given as more than this.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads, as many as they are on disk. Nothing is run for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)
