"""File scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INGEST_ORDER = "ingest_order"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table; a missing path raises."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed feed with its ingest order: ingest date, then file, then row in the file."""
    dated = T.StructType([*schema.fields, T.StructField("ingest_date", T.DateType())])
    df = spark.read.schema(dated).parquet(path)
    order = F.struct(
        "ingest_date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return df.select(*schema.names, order.alias(INGEST_ORDER))


def read_feed_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """A feed delivered as CSV with a header or as JSON lines, with its ingest order: file, then row."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"no feed reader for {fmt}")
    reader = spark.read.schema(schema)
    df = read_csv(spark, path, schema) if fmt == "csv" else reader.json(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return df.select(*schema.names, order.alias(INGEST_ORDER))


def list_parquet_files(spark: SparkSession, root: str) -> DataFrame:
    """Every parquet file below a folder. Only file footers and listings are read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select("path", "length", "modificationTime")
        .orderBy("path")
    )


def read_tree(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All parquet files below a folder as one frame, with the file each row came from."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
