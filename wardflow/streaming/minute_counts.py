"""Per-minute attendance counts, as a batch aggregate and as an exactly-once stream table.

The stream table is a log of per-batch counts: each micro-batch is aggregated on its own and
written to its own `batch_id=` folder, and readers add the counts up. Old minutes can be updated
for ever without any state store, and a replayed batch replaces its folder instead of counting
twice. `compact` folds old folders into a base next to the log, by day: only days with new rows are
written again. Where late data may be dropped, `windowed_counts`
keeps the sums in the state store behind a watermark instead.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.calendar import minute
from ..operators.dedup import keep_latest
from ..operators.snapshots import trailing_minutes
from ..sources import files
from .events import decode

COUNTS = ("attendances", "ambulance", "high_acuity", "breach_risk")
LOG = T.StructType([*schemas.MINUTE_COUNTS.fields, T.StructField("batch_id", T.LongType())])


def _counts() -> list:
    return [
        F.count("event_id").alias("attendances"),
        F.count_if(F.col("arrival_mode") == "ambulance").alias("ambulance"),
        F.count_if(F.col("acuity") <= 2).alias("high_acuity"),
        F.count_if(F.col("is_breach_risk")).alias("breach_risk"),
    ]


def minute_counts(events: DataFrame) -> DataFrame:
    """Counts by minute, hospital and region (rows without a key are left out)."""
    return (
        events.withColumn("minute_ts", minute(F.col("event_ts")))
        .dropna(subset=["minute_ts", "hospital_id", "region_id"])
        .groupBy("minute_ts", "hospital_id", "region_id")
        .agg(*_counts())
    )


def merge_counts(log: DataFrame) -> DataFrame:
    """One row per minute and hospital: counts added up, region of the first batch."""
    return log.groupBy("minute_ts", "hospital_id").agg(
        F.min_by("region_id", F.struct("batch_id", "region_id")).alias("region_id"),
        *[F.sum(c).alias(c) for c in COUNTS],
    ).select(*schemas.MINUTE_COUNTS.names)


def windowed_counts(events: DataFrame, lateness: str) -> DataFrame:
    """Tumbling one-minute windows with bounded state. Rows later than `lateness` are dropped;
    `dropped_late` counts them."""
    return (
        events.withColumn("event_time", F.col("event_ts").cast("timestamp"))
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", "1 minute"), "hospital_id")
        .agg(F.min("region_id").alias("region_id"), *_counts())
        .select(F.col("window.start").alias("minute_ts"), "hospital_id", "region_id", *COUNTS)
    )


def start_counts(
    events: DataFrame,
    table: str,
    checkpoint: str,
    archive: str | None = None,
    trigger: dict | None = None,
    dead: str | None = None,
) -> StreamingQuery:
    """Maintain the count log, and optionally an archive of the raw events of each batch.

    With `dead` the input is messages (see events.encode): each batch is decoded, and messages that
    are no events are kept in a folder of their batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if dead:
            batch, letters = decode(batch)
            letters.write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}")
        if archive:
            batch.write.mode("overwrite").parquet(f"{archive}/batch_id={batch_id}")
            batch = batch.sparkSession.read.schema(batch.schema).parquet(f"{archive}/batch_id={batch_id}")
        minute_counts(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _versions(spark: SparkSession, table: str) -> list[tuple[int, dt.date | None, str]]:
    """(last batch, closing day, folder) of the complete versions of a log's base, oldest first.

    A version is complete, and readers see it, once its job has left the _SUCCESS file.
    """
    out = []
    for name in files.children(spark, f"{table}_base"):
        if files.exists(spark, f"{table}_base/{name}/_SUCCESS"):
            upto, _, closed = name.removeprefix("upto=").partition(".closed=")
            out.append((int(upto), dt.date.fromisoformat(closed) if closed else None, name))
    return sorted(out, key=lambda v: v[0])


def base_days(spark: SparkSession, table: str) -> dict[str, str]:
    """Folder of each day of the base: that of the newest version which has the day."""
    days = {}
    for _, _, name in _versions(spark, table):
        for day in files.children(spark, f"{table}_base/{name}"):
            if day.startswith("day="):
                days[day.removeprefix("day=")] = f"{table}_base/{name}/{day}"
    return days


def _state(spark: SparkSession, table: str) -> tuple[int, dt.date | None]:
    return (_versions(spark, table) or [(-1, None, "")])[-1][:2]


def _base(spark: SparkSession, folders: list[str], upto: int) -> DataFrame:
    """Days of the base as one batch, the last one they hold."""
    if not folders:
        return spark.createDataFrame([], LOG)
    stored = spark.read.schema(schemas.MINUTE_COUNTS).parquet(*folders)
    return stored.withColumn("batch_id", F.lit(upto).cast("long"))


def _after(spark: SparkSession, table: str, upto: int, last: int | None = None) -> DataFrame:
    """Batches of the log after the base, with the day of each minute."""
    log = spark.read.schema(LOG).parquet(table).filter(F.col("batch_id") > upto)
    log = log if last is None else log.filter(F.col("batch_id") <= last)
    return log.withColumn("day", F.to_date("minute_ts"))


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    """Counts from the base and the batches after it, without late rows of closed days."""
    upto, closed = _state(spark, table)
    log = _after(spark, table, upto)
    log = log if closed is None else log.filter(F.col("day") >= F.lit(closed))
    base = _base(spark, list(base_days(spark, table).values()), upto)
    return merge_counts(log.drop("day").unionByName(base))


def compact(spark: SparkSession, table: str, upto: int, closed_before: dt.date | None = None) -> None:
    """Fold the batches up to `upto` into the base, while the stream goes on.

    The base is kept by day. A new version holds only the days these batches have rows of, each with its
    counts so far; other days stay in the files they are in, which the new version does not touch. Days
    before `closed_before` are closed from the next batch on: what comes later for them is put aside in
    `<table>_late`, never folded, and `late_counts` counts it.
    """
    done, closed = _state(spark, table)
    if upto <= done:
        return
    log = _after(spark, table, done, upto)
    if closed is not None:
        late = F.col("day") < F.lit(closed)
        log.filter(late).drop("day").write.mode("overwrite").parquet(f"{table}_late/upto={upto}")
        log = log.filter(~late)
    touched = [str(r["day"]) for r in log.select("day").distinct().collect()]  # days: as many as the calendar has
    held = base_days(spark, table)
    base = _base(spark, [held[d] for d in touched if d in held], done)
    merged = merge_counts(log.drop("day").unionByName(base)).withColumn("day", F.to_date("minute_ts"))
    closing = max((c for c in (closed, closed_before) if c is not None), default=None)
    name = f"upto={upto}" + (f".closed={closing}" if closing else "")
    merged.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{table}_base/{name}")


def late_counts(spark: SparkSession, table: str) -> DataFrame:
    """Counts that came too late for their closed days: put aside, or still in the log."""
    upto, closed = _state(spark, table)
    log = _after(spark, table, upto).filter(F.col("day") < F.lit(closed)).drop("day")
    aside = [f"{table}_late/{n}" for n in files.children(spark, f"{table}_late")]
    if aside:
        log = log.unionByName(spark.read.schema(LOG).parquet(*aside))
    return merge_counts(log)


def drop_folded(spark: SparkSession, table: str) -> None:
    """Delete batches that the base holds, and days that a newer version has, once no reader uses them."""
    versions = _versions(spark, table)
    if not versions:
        return
    for name in files.children(spark, table):
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) <= versions[-1][0]:
            files.remove(spark, f"{table}/{name}")
    used = {*base_days(spark, table).values()}
    for _, _, name in versions[:-1]:
        days = [d for d in files.children(spark, f"{table}_base/{name}") if d.startswith("day=")]
        for day in days:
            if f"{table}_base/{name}/{day}" not in used:
                files.remove(spark, f"{table}_base/{name}/{day}")
        if not any(f"{table}_base/{name}/{d}" in used for d in days):
            files.remove(spark, f"{table}_base/{name}")


def start_windows(
    events: DataFrame, table: str, checkpoint: str, lateness: str, trigger: dict | None = None
) -> StreamingQuery:
    """Maintain windowed_counts: each batch writes the changed windows with their full counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        windowed_counts(events, lateness).writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def dropped_late(query: StreamingQuery) -> int:
    """Rows the watermark dropped, summed over the batches the query still reports (see
    spark.sql.streaming.numRecentProgressUpdates)."""
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    return sum(s.get("numRowsDroppedByWatermark", 0) for s in states)


def read_windows(spark: SparkSession, table: str) -> DataFrame:
    """Newest version of every window."""
    log = spark.read.schema(LOG).parquet(table)
    return keep_latest(log, ["minute_ts", "hospital_id"], ["batch_id"]).drop("batch_id")


def archive_events(events: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append-only archive with Spark's exactly-once file sink."""
    return (
        events.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_bounded(query: StreamingQuery, timeout: int | None = None) -> None:
    """Wait for a bounded query; stop it and raise when it takes too long."""
    done = query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if done is False:
        query.stop()
        raise TimeoutError("stream did not drain in time")


def trailing_series(counts: DataFrame, minutes: int = 60) -> DataFrame:
    """National per-minute sums over the newest minutes of the data."""
    return (
        trailing_minutes(counts, minutes)
        .groupBy("minute_ts")
        .agg(*[F.sum(c).alias(c) for c in ("attendances", "ambulance", "breach_risk")])
        .orderBy("minute_ts")
    )


def totals(series: DataFrame) -> DataFrame:
    return series.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attendances", "ambulance", "breach_risk")]
    )


def run_summary(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("minute_ts").alias("minutes"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
    )
