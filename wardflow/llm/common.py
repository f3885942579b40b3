"""Helpers the text operators share: exact column picks and batch-wise Python in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows a task turns into Python objects at a time.
ROWS = 128


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only. Names match exactly, so an extra `TEXT` next to `text` is no clash."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def map_lists(
    df: DataFrame, schema: str, work: Callable[..., list[list] | tuple], rows: int = ROWS
) -> DataFrame:
    """Apply `work(*columns as lists) -> columns as lists` to pieces of at most `rows` rows.

    The output may have any number of rows. Memory is bounded by one Arrow batch plus one piece.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                out = work(*[c.to_pylist() for c in piece.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)
