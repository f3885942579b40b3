"""Kafka as source and sink. The connector jar must be on the cluster's class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.events import encode


def source_options(servers: str, topics: list[str], group: str | None = None,
                   per_batch: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
    }
    if group:
        options["kafka.group.id"] = group
    if per_batch:
        options["maxOffsetsPerTrigger"] = str(per_batch)
    return options


def messages(spark: SparkSession, servers: str, topics: list[str], **kw) -> DataFrame:
    """(topic, key, value) stream with UTF-8 text."""
    df = spark.readStream.format("kafka").options(**source_options(servers, topics, **kw)).load()
    return df.select(
        "topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


def sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def publish(events: DataFrame, servers: str, topic: str) -> None:
    """Write a batch of events keyed by hospital."""
    encode(events).write.format("kafka").options(**sink_options(servers, topic)).save()


def publish_stream(events: DataFrame, servers: str, topic: str, checkpoint: str):
    return (
        encode(events).writeStream.format("kafka").options(**sink_options(servers, topic))
        .option("checkpointLocation", checkpoint).start()
    )
