"""Folders of the cluster's file system, by Hadoop's API: any store Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if the folder is not there."""
    files, where = _at(spark, path)
    if not files.exists(where):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(where))


def remove(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    files, where = _at(spark, path)
    files.create(where, True).close()
