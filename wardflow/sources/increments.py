"""Tables loaded by ranges of days, with a manifest of what each run replaced.

A run replaces the days START..END of a table, and only these: rows are written with dynamic partition
overwrite, days of the range that have no rows any more are removed. The manifest keeps one row per run and
day with its number of rows; a rerun of the same run replaces its own entry, so running twice is running
once. Runs are ordered by their names (a time stamp does). Day counts are read from the manifest, so that
row numbers over all days need no second look at the table.

Runs of overlapping ranges must not write at the same time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import project
from . import files

MANIFEST = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("first_day", T.DateType()), T.StructField("last_day", T.DateType()),
    T.StructField("day", T.DateType()), T.StructField("n_rows", T.LongType()),
])


def _runs(path: str) -> str:
    return f"{path}_runs"


def load_days(
    df: DataFrame, path: str, schema: T.StructType, start: dt.date, end: dt.date, run: str, day: str = "date_key"
) -> None:
    """Replace the days start..end of the table at `path` by the rows of `df` that lie in them.

    The table is written first and the manifest last; a run that breaks off in between is repeated whole.
    """
    spark = df.sparkSession
    rows = project(df, schema).filter(F.col(day).between(F.lit(start), F.lit(end)))
    # rows of a day meet in one file or, for a hot day, a few
    writer = rows.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day).parquet(path)

    # what was written, counted from file footers; the days of the range are few
    stored = read_days(spark, path, schema, day).filter(F.col(day).between(F.lit(start), F.lit(end)))
    counts = stored.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    keyed = [r["day"] for r in rows.select(F.col(day).alias("day")).distinct().collect()]
    for name in files.children(spark, path):
        if name.startswith(f"{day}="):
            value = dt.date.fromisoformat(name.split("=", 1)[1])
            if start <= value <= end and value not in keyed:
                files.remove(spark, f"{path}/{name}")
    counts = counts.filter(F.col("day").isin(keyed)) if keyed else counts.limit(0)
    entry = spark.range(1).select(F.lit(start).alias("first_day"), F.lit(end).alias("last_day")).join(counts, F.lit(True), "left")
    entry.select("first_day", "last_day", "day", "n_rows").coalesce(1).write.mode("overwrite").parquet(f"{_runs(path)}/run={run}")


def read_days(spark: SparkSession, path: str, schema: T.StructType, day: str = "date_key") -> DataFrame:
    """The table, its columns in the order of the schema."""
    if not any(n.startswith(f"{day}=") for n in files.children(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run, first_day, last_day, day, n_rows): per run the days it wrote; one row without a day if none."""
    if not files.children(spark, _runs(path)):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(_runs(path)).select(*MANIFEST.names)


def day_counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, n_rows) of the days the table has now: each by the newest run whose range holds it."""
    runs = manifest(spark, path)
    ranges = runs.select("run", "first_day", "last_day").distinct()
    # one row per run and day of its range: the calendar times the runs that overlap
    owned = ranges.select("run", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    newest = owned.groupBy("day").agg(F.max("run").alias("run"))
    return newest.join(runs.select("run", "day", "n_rows"), ["run", "day"]).select("day", "n_rows")


def with_day_offset(df: DataFrame, counts: DataFrame, day: str = "date_key", name: str = "rows_before") -> DataFrame:
    """Adds the number of rows on earlier days, from (day, n_rows): one row per day is summed up in order."""
    before = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("day").alias(day), F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias(name))
    return df.join(offsets, day, "left")
