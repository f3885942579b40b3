"""Temporal back-test: hold out the newest days, fit on the rest, compare."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.cleaning import project
from ..operators.dedup import union_or_empty
from ..operators.scores import error_scores
from ..operators.snapshots import latest, split_holdout
from ..sources.layers import store
from ..sources.tables import create_or_replace
from . import training
from .together import run_together

log = logging.getLogger(__name__)
HOLDOUT_DAYS = 30


def _national(fact: DataFrame, held: DataFrame, target: str, how: str, forecast: DataFrame) -> DataFrame:
    actual = training.national_daily(held, target, how).select("date_key", F.col(target).alias("actual"))
    return actual.join(
        forecast.select("date_key", F.col("yhat").alias("predicted")), "date_key"
    ).dropna()


def backtest(
    fact: DataFrame, evaluated_at: str | dt.datetime, trees: int | None = None, holdout_days: int = HOLDOUT_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(metrics per model, predicted-vs-actual series of the occupancy model).

    A model with too little history to fit has a row without scores and 0 evaluated points; any
    other failure is raised. Pass a stored fact.
    """
    spark = fact.sparkSession
    train, held = split_holdout(fact, holdout_days)
    train = store(train, "train")
    extra = {} if trees is None else {"trees": trees}

    def occupancy() -> DataFrame:
        target = "bed_occupancy_pct"
        return _national(fact, held, target, "mean", training.occupancy_forecast(train, holdout_days, **extra))

    def attendance() -> DataFrame:
        forecast = training.attendance_forecast(train, holdout_days).filter("is_future")
        return _national(fact, held, "ae_attendances", "sum", forecast)

    def waiting() -> DataFrame:
        model = training.WaitingTimes((holdout_days,), **extra).fit(train)
        keys = ["target_date", *training.SERIES]
        actual = held.select(
            F.col("date_key").alias("target_date"), *training.SERIES,
            F.col("median_wait_days").cast("double").alias("actual"),
        )
        predicted = model.predict(train, holdout_days).withColumnRenamed(f"pred_{holdout_days}d", "predicted")
        return predicted.drop("date_key").join(actual, keys).withColumnRenamed("target_date", "date_key")

    jobs: list[tuple[str, str, Callable[[], DataFrame]]] = [
        ("Capacity pressure", "trend+gbt", occupancy),
        ("A&E demand", "trend", attendance),
        ("Waiting time", "gbt", waiting),
    ]

    def pairs_of(target: str, model: str, job: Callable[[], DataFrame]) -> DataFrame | None:
        try:
            return store(_pairs(job(), target, model), "pairs")
        except training.TooLittleHistory as exc:  # must not hide the other models
            log.warning("back-test of %s skipped: %s", target, exc)
            return None

    found = run_together(spark, {target: partial(pairs_of, target, model, job) for target, model, job in jobs})
    scored, series = [], []
    for target, model, job in jobs:
        pairs = found[target]
        if pairs is None:
            scored.append(spark.sql(f"SELECT '{target}' AS target, '{model}' AS model, 0L AS n_eval"))
            continue
        scored.append(error_scores(pairs, ["target", "model"]))
        if job is occupancy:
            series.append(pairs.select("target", "date", "actual", "predicted"))
    return _stamped(spark, scored, holdout_days, evaluated_at), union_or_empty(spark, series, schemas.FORECAST_ACTUAL)


def _pairs(df: DataFrame, target: str, model: str) -> DataFrame:
    return df.select(
        F.lit(target).alias("target"), F.lit(model).alias("model"), F.col("date_key").alias("date"), "actual", "predicted"
    )


def _stamped(spark: SparkSession, scored: list[DataFrame], holdout_days: int, evaluated_at) -> DataFrame:
    metrics = union_or_empty(spark, [project(s, schemas.MODEL_METRICS) for s in scored], schemas.MODEL_METRICS)
    metrics = metrics.withColumns(
        {"holdout_days": F.lit(holdout_days), "evaluated_at": F.lit(str(evaluated_at)).cast("timestamp")}
    )
    return metrics


def naive_backtest(fact: DataFrame, evaluated_at: str | dt.datetime, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """Metrics of forecasts anyone can make, to hold the models against.

    National series: the value of the same weekday in the last week before the hold-out. Waiting times:
    the wait `holdout_days` earlier. Pass a stored fact.
    """
    cutoff = F.date_sub(latest(fact), holdout_days)
    weeks = F.ceil(F.datediff("date_key", cutoff) / 7).cast("int")

    def weekday(target: str, how: str) -> DataFrame:
        daily = store(training.national_daily(fact, target, how).select("date_key", target), "daily")
        held = daily.filter(F.col("date_key") > cutoff).select(
            "date_key", F.col(target).alias("actual"), F.date_sub("date_key", weeks * 7).alias("source")
        )
        return held.join(daily.select(F.col("date_key").alias("source"), F.col(target).alias("predicted")), "source")

    keys = ["date_key", *training.SERIES]
    wait = F.col("median_wait_days").cast("double")
    held = fact.filter(F.col("date_key") > cutoff).select(*keys, wait.alias("actual"))
    earlier = fact.filter(F.col("date_key") <= cutoff).select(
        F.date_add("date_key", holdout_days).alias("date_key"), *training.SERIES, wait.alias("predicted")
    )
    frames = {
        "Capacity pressure": weekday("bed_occupancy_pct", "mean"),
        "A&E demand": weekday("ae_attendances", "sum"),
        "Waiting time": held.join(earlier, keys),
    }
    scored = [error_scores(_pairs(df, target, "naive"), ["target", "model"]) for target, df in frames.items()]
    return _stamped(fact.sparkSession, scored, holdout_days, evaluated_at)


def run_and_persist(fact: DataFrame, evaluated_at, path: str | None = None, **kw) -> DataFrame:
    metrics, series = backtest(fact, evaluated_at, **kw)
    at = (lambda name: f"{path}/{name}") if path else (lambda name: None)
    create_or_replace(metrics, "model_metrics", at("model_metrics"))
    create_or_replace(series, "model_forecast_actual", at("model_forecast_actual"))
    return metrics
