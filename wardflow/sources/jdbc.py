"""Serving database over JDBC: parameterised reads, batched writes with retries, publishing.

No database is reachable in the test environment: option maps, retry and ordering are tested with
stand-in writers, the round trip is not.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

BATCH_SIZE = 200
MAX_ATTEMPTS = 4

# Load order that respects foreign keys, and tables that may be absent.
TABLES = (
    "dim_date", "dim_hospital", "dim_specialty", "dim_region",
    "hospital_activity_fact", "ml_forecast", "risk_score", "recommendation",
)
OPTIONAL_TABLES = ("ae_stream_agg", "ae_dept_state", "model_metrics", "model_forecast_actual")


def read_query(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Run a SELECT in the database; filters and columns chosen later are pushed into it."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    return reader.options(**(properties or {})).load()


def read_table(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Parallel read of a large table, split on a numeric column."""
    options = {
        "url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(lower),
        "upperBound": str(upper), "numPartitions": str(partitions),
    }
    return spark.read.format("jdbc").options(**options, **(properties or {})).load()


def query_view(spark: SparkSession, query: str, **params) -> DataFrame:
    """Parameterised SELECT over the session's views and tables (`:name` markers)."""
    return spark.sql(query, args=params)


def write_options(url: str, table: str, truncate: bool = False) -> dict[str, str]:
    return {
        "url": url, "dbtable": table, "batchsize": str(BATCH_SIZE), "truncate": str(truncate).lower(),
    }


# What drivers say when a later attempt may succeed.
TRANSIENT = (
    "SQLTransient", "SQLRecoverable", "CommunicationsException", "Connection refused", "Connection reset",
    "connection has been closed", "timed out", "timeout", "deadlock", "could not serialize",
)


def is_transient(exc: Exception) -> bool:
    """Lost connections, timeouts and deadlocks; wrong columns, types or rights are not."""
    text = f"{type(exc).__name__}: {exc}".lower()
    return any(t.lower() in text for t in TRANSIENT)


def with_retries(action: Callable[[], None], label: str, sleep: Callable[[float], None] = time.sleep,
                 transient: Callable[[Exception], bool] = is_transient) -> int:
    """Run a write up to four times, waiting 2, 4, 8 seconds; returns the attempts used. Errors
    that are not transient are raised at once."""
    for attempt in range(1, MAX_ATTEMPTS + 1):
        try:
            action()
            return attempt
        except Exception as exc:
            if attempt == MAX_ATTEMPTS or not transient(exc):
                raise
            wait = 2 ** attempt
            log.warning("%s failed (attempt %d), retry in %d s: %s", label, attempt, wait, exc)
            sleep(wait)
    raise AssertionError("unreachable")


def write_table(
    df: DataFrame, url: str, table: str, mode: str = "append",
    properties: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep,
    swap: Callable[[str, str], None] | None = None,
) -> int:
    """Write a frame with retries; mode is "append" or "replace".

    Spark commits per partition, so a retried append could load rows twice. An append therefore
    needs `swap`: each attempt overwrites a staging table, and swap(staging, table) moves its rows
    in one transaction. A replace starts from an empty table at each attempt.
    """
    if mode == "append" and swap is None:
        raise ValueError("an append that may be retried needs swap(staging, table)")
    target = f"{table}_staging" if swap else table
    save_mode = "overwrite" if swap or mode == "replace" else mode

    def save() -> None:
        options = write_options(url, target, truncate=save_mode == "overwrite")
        df.write.format("jdbc").options(**options, **(properties or {})).mode(save_mode).save()

    attempts = with_retries(save, table, sleep)
    if swap:
        swap(target, table)
    return attempts


def publisher(
    url: str, swap: Callable[[str, str], None], properties: dict[str, str] | None = None
) -> Callable[[DataFrame, str, str], int]:
    """The `write` of publish(): every table goes through a staging table."""
    return lambda df, name, mode: write_table(df, url, name, mode, properties, swap=swap)


def publish(
    tables: dict[str, DataFrame],
    write: Callable[[DataFrame, str, str], object],
    clear: Callable[[Iterable[str]], None],
    rebuild_views: Callable[[], None],
) -> list[str]:
    """Clear the typed tables, load dimensions, fact and analytics in key order, then the optional
    tables, then the views. Returns the tables loaded."""
    clear(TABLES)
    loaded = []
    for name in TABLES + OPTIONAL_TABLES:
        if name not in tables:
            log.warning("publish: %s is missing", name)
            continue
        write(tables[name], name, "append" if name in TABLES else "replace")
        loaded.append(name)
    rebuild_views()
    return loaded
