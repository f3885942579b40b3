"""Department state: national minute series, newest state and pressure against the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_exact

SUMS = (
    "arrivals", "admissions", "discharges", "available_beds", "queue_length", "ambulances_waiting",
    "breach_risk",
)
RECENT = 20


def national_series(state: DataFrame) -> DataFrame:
    """Per minute over all hospitals; works on a batch or on a stream (in update mode)."""
    return state.groupBy("minute_ts").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.round(F.avg(F.col("occupancy_pct").cast("double")), 1).alias("occupancy_pct"),
    )


def newest_state(series: DataFrame) -> DataFrame:
    cols = ["arrivals", "available_beds", "queue_length", "ambulances_waiting", "breach_risk"]
    return series.orderBy(F.desc("minute_ts")).limit(1).select(
        "minute_ts", *[F.col(c).cast("long").alias(c) for c in cols],
        F.col("occupancy_pct").cast("double").alias("occupancy_pct"),
    )


def pressure_metrics(series: DataFrame) -> DataFrame:
    """Newest 20 minutes against all earlier ones (the very first one when there are no others).

    The border is the oldest of the newest 20 minutes, found as a top-k; the rest is one pass of
    conditional averages.
    """
    series = series.withColumn("_ts", F.col("minute_ts"))
    newest = series.select("_ts").orderBy(F.desc("_ts")).limit(RECENT)
    border = newest.agg(F.min("_ts")).scalar()
    first = series.agg(F.min("_ts")).scalar()
    recent = F.col("_ts") >= border
    base = (F.col("_ts") < border) | ((F.col("_ts") == first) & (F.lit(True) == (first == border)))

    def over(rows, c):
        return F.avg(F.when(rows, F.col(c).cast("double")))

    row = series.agg(
        over(recent, "arrivals").alias("arr"),
        F.greatest(over(base, "arrivals"), F.lit(0.01)).alias("arr0"),
        over(recent, "occupancy_pct").alias("occ"),
        F.max_by("available_beds", "_ts").alias("beds"),
        over(base, "available_beds").alias("beds0"),
        F.max_by("queue_length", "_ts").alias("queue"),
        F.max_by("ambulances_waiting", "_ts").alias("amb_now"),
        over(recent, "ambulances_waiting").alias("amb"),
        F.greatest(over(base, "ambulances_waiting"), F.lit(0.01)).alias("amb0"),
    )
    c = F.col

    def change(now, before):
        return round_exact((c(now) - c(before)) / c(before) * 100, 1)

    return row.select(
        change("arr", "arr0").alias("arrivals_vs_baseline_pct"),
        round_exact(c("occ"), 1).alias("occupancy_pct"),
        c("beds").cast("long").alias("available_beds_now"),
        (c("beds") - c("beds0")).cast("long").alias("available_beds_change"),
        c("queue").cast("long").alias("queue_now"),
        c("amb_now").cast("long").alias("ambulances_waiting_now"),
        change("amb", "amb0").alias("ambulances_vs_baseline_pct"),
    )
