"""Tables that are checked in the pass that writes them.

The rules of a table are aggregates observed while its rows are written (`DataFrame.observe`), so checking
reads nothing again. Each write is a version of its own; it counts once its rules held, which an empty
marker file says. A broken feed stops the job, and readers go on with the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

MARK = "_checked"


class BrokenFeed(ValueError):
    """Rows that were written break a rule of their table."""

    def __init__(self, path: str, broken: dict[str, Any]):
        super().__init__(f"{path}: " + ", ".join(f"{name} is {value}" for name, value in broken.items()))
        self.broken = broken


@dataclass(frozen=True)
class Rule:
    """An aggregate over all rows, and whether its value is right."""

    name: str
    metric: Column
    holds: Callable[[Any], bool]


def at_least(rows: int) -> Rule:
    return Rule("n_rows", F.count(F.lit(1)), lambda n: n >= rows)


def never_null(*cols: str) -> list[Rule]:
    return [Rule(f"{c}_nulls", F.count_if(F.col(c).isNull()), lambda n: n == 0) for c in cols]


def between(col: str, low: Any, high: Any) -> list[Rule]:
    """The known values lie in a closed range; a table without any fits."""
    return [
        Rule(f"{col}_min", F.min(col), lambda v: v is None or v >= low),
        Rule(f"{col}_max", F.max(col), lambda v: v is None or v <= high),
    ]


def null_share(col: str, most: float) -> Rule:
    share = F.count_if(F.col(col).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return Rule(f"{col}_null_share", share, lambda v: v <= most)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions whose rules held, oldest first."""
    return [n for n in files.children(spark, path) if files.exists(spark, f"{path}/{n}/{MARK}")]


def write_checked(
    df: DataFrame, path: str, rules: list[Rule], version: str, partition_by: list[str] | None = None
) -> dict[str, Any]:
    """Write a version of the table at `path`; the values of its rules. Versions are ordered by their names.

    Raises BrokenFeed, and drops what it wrote, if a rule does not hold. A version written again replaces
    itself.
    """
    spark = df.sparkSession
    seen = Observation(f"rules {uuid.uuid4().hex}")
    watched = df.observe(seen, *[r.metric.alias(r.name) for r in rules])
    files.remove(spark, f"{path}/{version}/{MARK}")
    writer = watched.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(f"{path}/{version}")
    values = seen.get
    broken = {r.name: values[r.name] for r in rules if not r.holds(values[r.name])}
    if broken:
        files.remove(spark, f"{path}/{version}")
        raise BrokenFeed(path, broken)
    files.mark(spark, f"{path}/{version}/{MARK}")
    return {r.name: values[r.name] for r in rules}


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest version whose rules held; no rows before the first."""
    held = _versions(spark, path)
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{held[-1]}").select(*schema.names)


def drop_older(spark: SparkSession, path: str) -> None:
    """Delete the versions before the newest one, once no reader uses them."""
    for name in _versions(spark, path)[:-1]:
        files.remove(spark, f"{path}/{name}")
