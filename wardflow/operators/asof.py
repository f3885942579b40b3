"""As-of join: for every left row the last right row at or before it.

Both sides are laid in one sequence per key and the right side's values are carried forward. A series may
be long, so it is cut into blocks of time: inside a block a window carries the values, and the last values
of each block are carried over the blocks by a second window that has one row per block. No task sorts a
whole series, and no row meets more than one other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    time: str,
    values: list[str],
    block: Column | None = None,
    at: Column | None = None,
    within: Column | None = None,
    prefix: str = "asof_",
) -> DataFrame:
    """Left rows with the `values` (and the time) of the last right row of the same key at or before them.

    `time` is a column of both sides; `at` is the moment a left row asks for, its time by default. `block`
    is an expression of the moment `_at` that names its block and never falls with time, by default year and month. `within` is the
    earliest time that still counts. Left rows without a key or time, or without an earlier right row, get
    NULL; right rows without one are left out. Of right rows with the same key and time, the greatest by
    their values counts. Equal NULL keys do not match.
    """
    columns = left.columns
    moment = F.col(time) if at is None else at
    names = {c: f"_v{i}" for i, c in enumerate([time, *values])}
    keys = [f"_k{i}" for i in range(len(by))]
    key_columns = [F.col(b).alias(k) for b, k in zip(by, keys)]
    asking = left.select(
        *key_columns, moment.alias("_at"), F.lit(1).alias("_side"), F.struct(*columns).alias("_row"),
        F.lit(None).cast(right.select(F.struct(time, *values).alias("v")).schema["v"].dataType).alias("_value"),
    )
    known = right.dropna(subset=[*by, time]).groupBy(*key_columns, F.col(time).alias("_at")).agg(
        F.max(F.struct(time, *values)).alias("_value")
    )
    told = known.select(
        *keys, "_at", F.lit(0).alias("_side"), F.lit(None).cast(asking.schema["_row"].dataType).alias("_row"), "_value"
    )
    blocks = (F.year("_at") * 12 + F.month("_at")) if block is None else block
    both = asking.unionByName(told).withColumn("_block", blocks)

    inside = Window.partitionBy(*keys, "_block").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_here", F.last("_value", ignorenulls=True).over(inside)).filter("_side = 1")
    # the newest value of each block, then of all blocks before it; blocks that only ask are in between
    ends = told.withColumn("_block", blocks).groupBy(*keys, "_block").agg(F.max_by("_value", "_at").alias("_end"))
    asked = asking.filter(F.col("_at").isNotNull()).select(*keys, blocks.alias("_block")).distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    earlier = Window.partitionBy(*keys).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    chain = asked.unionByName(ends).withColumn("_before", F.last("_end", ignorenulls=True).over(earlier))
    before = chain.groupBy(*keys, "_block").agg(F.first("_before").alias("_before"))

    found = carried.join(before, [*keys, "_block"], "left").withColumn("_value", F.coalesce("_here", "_before"))
    if within is not None:
        found = found.select("_row.*", "_value").withColumn("_value", F.when(F.col(f"_value.{time}") >= within, F.col("_value")))
    else:
        found = found.select("_row.*", "_value")
    return found.select(*columns, *[F.col(f"_value.{c}").alias(prefix + c) for c in names])
