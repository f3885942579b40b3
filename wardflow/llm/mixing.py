"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies. Documents stand in order of size
within their source; with the running sum of expected copies plus one random offset, a document is
emitted once per integer boundary its step crosses. As neighbours in that order are about equally
long, the words taken come within about one document's size of the target. The offset is drawn `draws`
times per mix, and each source keeps the draw that brings its words nearest to its target, the earliest of
equal ones, which matters for sources of few documents. Without draws each source has one offset, a step of
the golden section from that of the source before it and, for the first, drawn from the seed.

Running sums need no sort of a source in one task: rows are range-partitioned by (source, size, id),
numbered inside each partition, and per-partition counts are summed into offsets. A hot source
spreads over many partitions.

Defined results: a null text has size 0; null is a source of its own, last in order; a source of
size 0 gets target 0 and no copies; rows alike in source, size and id may swap their copies, which
leaves the same rows; an empty table gives an empty mix.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.sources.layers import store

from .common import DOCUMENT, pick

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SEED, DRAWS, GOLDEN = 20_240_917, 32, 0.6180339887498949


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offsets(seed: int = SEED, draws: int = DRAWS) -> list[float]:
    draw = random.Random(seed)
    return [draw.random() for _ in range(draws)]


def first_offset(seed: int = SEED) -> float:
    return random.Random(seed).random()


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rank) from (source, source_size); ranks go from 0 by source.

    Shares go by weight; a target above MOST times its source's size stops there and the excess is
    reshared until none is above. In order of cap per unit of weight that is one pass: a source stops
    at its cap if the share left for it and all later ones exceeds the cap. The windows run over one
    row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("rank", rank).withColumn("cap", F.col("source_size") * MOST)
    earlier = everything.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    rows = rows.withColumn("each", left / weights)
    capped = F.col("each") * F.col("weight") >= F.col("cap")
    level = F.min(F.when(~capped, F.struct(F.col("cap") / F.col("weight"), "rank", "each"))).over(everything)["each"]
    target = F.when(capped, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"), "rank")


def mix(docs: DataFrame, seed: int = SEED, draws: int = 0) -> DataFrame:
    """Adds source_size, target and copies to rows with (doc_id, source, size).

    With `draws` each source takes the nearest of so many offsets, else its only one.
    """
    order = ["source", "size", "doc_id"]
    at = F.monotonically_increasing_id()  # its upper bits number the partition, the lower ones the row
    rows = store(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "in_order")
    part = F.shiftright("_at", 33)
    runs = rows.groupBy(part.alias("_part"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"), F.sum("size").alias("words")
    )
    runs = store(runs, "runs")
    targets = source_targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    runs = runs.select(F.col("source").alias("_source"), "_part", "_first", before)
    runs = runs.join(targets, runs["_source"].eqNullSafe(targets["source"])).drop("source")
    runs = store(runs, "run_offsets")
    rows = rows.withColumn("_own", part)
    placed = rows.join(runs, (rows["_own"] == runs["_part"]) & rows["source"].eqNullSafe(runs["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    placed = placed.withColumns({"_rate": rate, "_place": place})
    crossed = lambda u: F.floor((F.col("_place") + 1) * F.col("_rate") + u) - F.floor(F.col("_place") * F.col("_rate") + u)

    step = F.col("rank") * GOLDEN + first_offset(seed)
    offset = step - F.floor(step)
    if draws:
        off = lambda u: F.abs(F.sum(crossed(u) * F.col("size")) - F.max("target"))
        tried = [F.struct(off(u).alias("off"), F.lit(i), F.lit(u).alias("u")) for i, u in enumerate(offsets(seed, draws))]
        chosen = placed.groupBy(F.col("source").alias("_source")).agg(F.array_min(F.array(*tried))["u"].alias("_u"))
        chosen = store(chosen, "offsets")
        placed = placed.drop("_source").join(chosen, placed["source"].eqNullSafe(chosen["_source"]))
        offset = F.col("_u")
    copies = crossed(offset).cast("int")
    return placed.select(*docs.columns, "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame, seed: int = SEED, draws: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row."""
    sized = store(pick(docs, "doc_id", "source", "text").select("doc_id", "source", words().alias("size")), "sizes")
    mixed = mix(sized, seed, draws)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy."""
    mixed = mix(pick(docs, *DOCUMENT).withColumn("size", words()), seed)
    return mixed.filter("copies > 0").select(
        *DOCUMENT, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
