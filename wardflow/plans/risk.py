"""Composite operational risk score per hospital on the newest date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scoring
from ..functions.numbers import mean, ratio, sum_or_zero
from ..operators.cleaning import project, with_defaults
from ..operators.positions import with_range_position
from ..operators.scores import peer_zscores
from ..operators.snapshots import latest
from ..sources.layers import store

GROWTH_DAYS = 30
SURGE_DAYS = 7


def _defaults(fact: DataFrame) -> DataFrame:
    metrics = ("waiting_list_size", "bed_occupancy_pct", "vacancy_rate", "ae_attendances")
    return with_defaults(
        fact, {"specialty_id": F.lit("ALL"), **{m: F.lit(0.0) for m in metrics}}
    )


def series_stats(fact: DataFrame, newest: Column) -> DataFrame:
    """Everything the score needs per hospital and specialty, from one pass over the fact.

    Current values, the as-of value 30 days before, the trailing week and the long-run sums are
    conditional partial aggregates, so the fact is shuffled once as one row per series and task.
    """
    d = F.col("date_key")
    now = d == newest
    past = d <= F.date_sub(newest, GROWTH_DAYS)
    week = d >= F.date_sub(newest, SURGE_DAYS)
    wl, ae = F.col("waiting_list_size"), F.col("ae_attendances")
    return fact.groupBy("hospital_id", "specialty_id").agg(
        F.count_if(now).alias("rows_now"),
        sum_or_zero(F.when(now, wl)).alias("wl_now"),
        mean(F.when(now, F.col("bed_occupancy_pct"))).alias("occupancy"),
        mean(F.when(now, F.col("vacancy_rate"))).alias("vacancy"),
        sum_or_zero(F.when(now, ae)).alias("ae_now"),
        F.max_by(wl, F.when(past, d)).alias("wl_past"),
        F.count_if(week).alias("rows_week"),
        sum_or_zero(F.when(week, ae)).alias("ae_week"),
        sum_or_zero(ae).alias("ae_sum"),
        F.count(ae).alias("ae_rows"),
    )


def growth(now: Column, past: Column) -> Column:
    """Relative change against the as-of value; a missing past counts as no change."""
    base = F.coalesce(past, now)
    return ratio(now - base, base)


def growth_30d(fact: DataFrame, zero_for_null: bool = False) -> DataFrame:
    """Mean 30-day waiting-list growth per hospital.

    A zero base has no growth rate: it is left out of the mean, or counts as 0 on request.
    """
    d = F.col("date_key")
    newest = latest(fact)
    wl = F.col("waiting_list_size")
    series = (
        fact.filter((d == newest) | (d <= F.date_sub(newest, GROWTH_DAYS)))
        .groupBy("hospital_id", "specialty_id")
        .agg(
            F.count_if(d == newest).alias("rows_now"),
            F.sum(F.when(d == newest, wl)).alias("now"),
            F.max_by(wl, F.when(d < newest, d)).alias("past"),
        )
        .filter(F.col("rows_now") > 0)
    )
    g = growth(F.col("now"), F.col("past"))
    return series.groupBy("hospital_id").agg(
        F.avg(F.coalesce(g, F.lit(0.0)) if zero_for_null else g).alias("waiting_list_growth_30d")
    )


def components(fact: DataFrame) -> DataFrame:
    """Score inputs per hospital. Surge compares the week with seven times the mean row."""
    fact = _defaults(fact)
    newest = latest(fact)
    series = series_stats(fact, newest)
    here = F.col("rows_now") > 0
    g = F.coalesce(growth(F.col("wl_now"), F.col("wl_past")), F.lit(0.0))
    hospitals = series.groupBy("hospital_id").agg(
        F.sum("rows_now").alias("_rows"),
        F.avg(F.when(here, F.col("occupancy"))).alias("bed_occupancy"),
        F.avg(F.when(here, g)).alias("waiting_list_growth"),
        F.sum(F.when(here, F.col("wl_now"))).cast("double").alias("waiting_list_size"),
        F.avg(F.when(here, F.col("vacancy"))).alias("vacancy_rate"),
        F.sum(F.when(here, F.col("ae_now"))).alias("ae_attendances"),
        F.when(F.sum("rows_week") > 0, F.sum("ae_week")).alias("ae_7d"),
        (ratio(F.sum("ae_sum"), F.sum("ae_rows")) * 7).alias("ae_baseline_7d"),
    )
    surge = ratio(F.col("ae_7d") - F.col("ae_baseline_7d"), F.col("ae_baseline_7d"))
    return (
        hospitals.filter(F.col("_rows") > 0)
        .drop("_rows")
        .withColumn("ae_surge_index", F.coalesce(surge, F.lit(0.0)))
        .withColumn("date_key", newest)
    )


def components_json(verdict_absolute: Column, verdict_relative: Column) -> Column:
    worse = scoring.severity_rank(verdict_absolute) > scoring.severity_rank(verdict_relative)
    return F.to_json(
        F.struct(
            F.col("bed_occupancy").alias("bed_occupancy_pct"),
            F.col("waiting_list_growth").alias("waiting_list_growth_30d"),
            F.col("vacancy_rate"),
            F.col("ae_surge_index"),
            F.when(worse, "absolute").otherwise("peer-relative").alias("trigger"),
        ),
        {"ignoreNullFields": "false"},
    )


def compute_risk(fact: DataFrame) -> DataFrame:
    """Components, z-scores, score, the relative, absolute and final class, and a JSON summary.

    The fact is read twice (its newest date, then its rows); pass a stored table, not a long plan.
    The components (one row per hospital) are stored, because the z-scores read them twice.
    """
    c = F.col
    z = peer_zscores(
        store(components(fact), "risk_components"),
        ["bed_occupancy", "waiting_list_growth", "waiting_list_size", "vacancy_rate", "ae_surge_index"],
    )
    z = (
        z.withColumn("waiting_list_z", c("waiting_list_growth_z") + c("waiting_list_size_z"))
        .withColumnRenamed("ae_surge_index_z", "ae_surge_z")
        .drop("waiting_list_growth_z", "waiting_list_size_z")
    )
    scored = (
        z.withColumn(
            "score",
            scoring.composite(
                c("bed_occupancy_z"), c("waiting_list_z"), c("vacancy_rate_z"), c("ae_surge_z")
            ),
        )
        .withColumn("classification_relative", scoring.relative_class(c("score")))
        .withColumn(
            "classification_absolute", scoring.absolute_class(c("bed_occupancy"), c("vacancy_rate"))
        )
    )
    relative, absolute = c("classification_relative"), c("classification_absolute")
    scored = scored.withColumn("classification", scoring.worse_of(relative, absolute))
    scored = scored.withColumn("components_json", components_json(absolute, relative))
    return with_range_position(scored, ["hospital_id"], name="risk_id")


def risk_table(scored: DataFrame) -> DataFrame:
    return project(scored, schemas.RISK)


def class_counts(risk: DataFrame) -> DataFrame:
    """Totals per class in one row, as a run reports them."""
    cls = F.col("classification")
    return risk.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(cls == name).alias(name.lower()) for name in ("Red", "Amber", "Green")],
    )
