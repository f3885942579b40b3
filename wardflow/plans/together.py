"""Independent Spark jobs side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")


def run_together(spark: SparkSession, jobs: dict[str, Callable[[], Result]]) -> dict[str, Result]:
    """Results by name. Each job runs in a thread and a scheduler pool of its own.

    With `spark.scheduler.mode` FAIR the pools share the executors evenly, so that a job of many small
    steps does not wait for a long one. The first failure is raised once all jobs have ended.
    """
    def pooled(name: str, job: Callable[[], Result]) -> Result:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        return job()

    with ThreadPoolExecutor(max(len(jobs), 1)) as threads:
        running = {
            name: threads.submit(inheritable_thread_target(spark)(pooled), name, job) for name, job in jobs.items()
        }
    return {name: job.result() for name, job in running.items()}
