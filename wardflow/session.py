"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # jobs that run side by side share the executors
    "spark.scheduler.mode": "FAIR",
    # call sites of every Column are not needed in jobs and slow plan building down
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "wardflow", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session. On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
