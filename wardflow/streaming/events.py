"""Attendance events: JSON encoding, decoding and bounded replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

KEY = "hospital_id"


def encode(events: DataFrame) -> DataFrame:
    """(key, value) messages; the key is the hospital, so that one site keeps its order."""
    fields = [F.col(f.name) for f in schemas.EVENT]
    return events.select(
        F.col(KEY).cast("string").alias("key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"),
    )


def decode(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, dead letters). A message is dead when it is not a JSON event with an id and a time."""
    parsed = messages.withColumn(
        "_e", F.from_json(F.col(value).cast("string"), schemas.EVENT.simpleString())
    )
    ok = F.col("_e.event_id").isNotNull() & F.col("_e.event_ts").try_cast("timestamp").isNotNull()
    events = parsed.filter(ok).select("_e.*")
    dead = parsed.filter(~F.coalesce(ok, F.lit(False))).drop("_e")
    return events, dead


def replay(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema=None, fmt: str = "parquet",
           files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream, for bounded replays with an availableNow trigger."""
    reader = spark.readStream.format(fmt).schema(schema or schemas.EVENT).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)
