"""Warehouse tables in the session catalog, and the file sinks of the layers."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import project

log = logging.getLogger(__name__)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A table, or an empty frame of the declared schema when it does not exist yet."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def replace_load(
    df: DataFrame, name: str, schema: T.StructType, path: str | None = None, partition_by: list[str] | None = None
) -> None:
    """Replace a table's rows, matching the target columns by name and type."""
    _save(project(df, schema), name, path, partition_by)


def create_or_replace(
    df: DataFrame, name: str, path: str | None = None, partition_by: list[str] | None = None
) -> None:
    """Replace a table and take the schema from the frame."""
    _save(df, name, path, partition_by)


def _save(df: DataFrame, name: str, path: str | None, partition_by: list[str] | None) -> None:
    """Partition columns come last in the table. Rows are gathered by partition value before the
    write, for few files; a hot value is split over several tasks."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_parquet(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """Overwrite a parquet table. Rows of one partition value may come from many tasks, so a hot
    value is written by many tasks too."""
    writer = df.write.mode("overwrite")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)


def land(feeds: dict[str, DataFrame], folder: str, ingest_date: dt.date | str) -> dict[str, str]:
    """Append raw feeds to the landing layer, one folder per feed and ingest date.

    Landing the same date again replaces that date only, so a rerun does not duplicate rows.
    """
    paths = {}
    for name, df in feeds.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(f"{path}/ingest_date={ingest_date}")
        paths[name] = path
    return paths


def export_csv(frames: dict[str, DataFrame | None], folder: str) -> list[str]:
    """Each named result as a CSV folder with a header; missing ones are skipped.

    Instants lose their time zone (the session is UTC).
    """
    written = []
    for name, df in frames.items():
        if df is None:
            log.warning("export: %s is missing", name)
            continue
        zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
        df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        written.append(name)
    return written


# Results a BI export holds.
EXPORTS = (
    "v_national_pressure", "v_regional_risk_latest", "v_top_risk_trusts", "v_forecast_long",
    "recommendation", "dim_region", "dim_hospital", "ae_dept_state", "model_metrics",
    "model_forecast_actual",
)


def export_views(spark: SparkSession, folder: str) -> list[str]:
    """Export every known view or table that exists in the session."""
    found = {n: spark.table(n) if spark.catalog.tableExists(n) else None for n in EXPORTS}
    return export_csv(found, folder)
