"""Exact row positions, surrogate ids and row-offset operators without one big sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layers import input_bytes, store

#: Bytes a frame reads per partition in which its rows are numbered.
POSITION_BYTES = 16 << 20


def with_position(
    df: DataFrame, levels: list[list[str]], by: list[str] | None = None, name: str = "position"
) -> DataFrame:
    """1-based position of each row in the order of the levels, within `by`.

    Levels go from coarse to fine, e.g. [["date_key"], ["hospital_id"], ["specialty_id"]]. Row
    counts of the coarse groups are summed into offsets level by level; rows are numbered only
    inside the finest group. The largest single-task sort is therefore the largest number of
    children of one group at one level (days, hospitals of a day, rows of a day and hospital),
    never the table. Level columns must not be NULL. Groups are dealt over as many partitions as the
    bytes read ask for, and sorted once, for the numbers and for the offsets.
    """
    by = by or []
    flat = [c for level in levels for c in level]
    outer, leaf = levels[:-1], levels[-1]
    if not outer:
        order = Window.partitionBy(*by).orderBy(*leaf) if by else Window.orderBy(*leaf)
        return df.withColumn(name, F.row_number().over(order).cast("long"))

    group = by + [c for level in outer for c in level]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    offsets: DataFrame | None = None
    for depth in range(len(outer)):
        parent = by + [c for level in outer[:depth] for c in level]
        here = parent + outer[depth]
        rows = counts.groupBy(*here).agg(F.sum("_n").alias("_n"))
        order = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = order.orderBy(*outer[depth]).rowsBetween(Window.unboundedPreceding, -1)
        step = rows.select(
            *here, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias(f"_before{depth}")
        )
        offsets = step if offsets is None else step.join(offsets, parent, "left")
    before = reduce(lambda a, b: a + b, [F.col(f"_before{d}") for d in range(len(outer))])
    offsets = offsets.select(*group, before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*leaf))
    assert set(flat) <= set(df.columns)
    return (
        dealt(df, group).withColumn("_inside", inside)
        .join(offsets, group, "left")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .select(*df.columns, name)
    )


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by the hash of their keys in as many partitions as the bytes read ask for.

    The session's number of shuffle partitions is the least, and is left to the planner.
    """
    wanted = input_bytes(df) // POSITION_BYTES + 1
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted, *keys) if wanted > least else df


def with_range_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """1-based position of each row in the order of columns that have no coarse levels, such as codes.

    Rows are range-partitioned and stored with their place in their partition; the counts of the
    partitions, one row each, are summed into offsets. No task sorts more than its range.
    """
    at = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    rows = store(rows, "in_order").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return rows.join(runs, "_part").select(*df.columns, place.alias(name))


def lag_by_position(
    df: DataFrame, col: str, n: int, position: str = "position", by: list[str] | None = None,
    name: str | None = None,
) -> DataFrame:
    """Value n rows earlier, as an equi-join on the position: no window, no task per series."""
    by = by or []
    earlier = df.select(
        *by, (F.col(position) + n).alias(position), F.col(col).alias(name or f"{col}_lag{n}")
    )
    return df.join(earlier, [*by, position], "left")


def blocked(
    df: DataFrame, by: list[str], position: str, rows: int, halo: int
) -> tuple[DataFrame, list[str], Column]:
    """Cut long series into blocks of `rows` rows, each preceded by a copy of `halo` rows.

    Returns the widened frame, the window keys, and the condition that keeps a row's own block.
    A trailing frame of at most `halo` rows then sees the same rows as over the whole series,
    while one task holds at most rows + halo rows of a series.
    """
    if halo > rows:
        raise ValueError("halo must not exceed the block size")
    index = F.col(position) - 1
    own = F.floor(index / rows)
    copies = F.when(index % rows >= rows - halo, F.array(own, own + 1)).otherwise(F.array(own))
    wide = df.withColumn("_own", own).withColumn("_block", F.explode(copies))
    return wide, [*by, "_block"], F.col("_own") == F.col("_block")
