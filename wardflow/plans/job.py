"""Batch job: landed feeds to cleaned tables, star schema, forecasts, risk, actions, back-test.

    spark-submit --py-files wardflow.zip run_job.py LANDING WAREHOUSE [START END]
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import build_dim_date
from ..session import build_session
from ..sources import increments
from ..sources.layers import store
from ..sources.scans import read_landed
from ..sources.tables import create_or_replace, replace_load
from . import backtest, recommend, risk, silver, star, training, views

DEFAULT_DAYS = 180
BY_DAY = "activity_by_day"


def date_range(args: list[str], today: dt.date) -> tuple[dt.date, dt.date]:
    """START END from the arguments, START alone up to today, or the last 180 days."""
    if not args:
        return today - dt.timedelta(days=DEFAULT_DAYS), today
    start, end = dt.date.fromisoformat(args[0]), dt.date.fromisoformat(args[1]) if args[1:] else today
    if start > end:
        raise ValueError(f"{start} is after {end}")
    return start, end


def landed_feeds(spark: SparkSession, landing: str) -> dict[str, DataFrame]:
    names = [n for n in schemas.FEEDS if n != "dim_date"]
    return {n: read_landed(spark, f"{landing}/{n}", schemas.FEEDS[n]) for n in names}


def build_warehouse(
    feeds: dict[str, DataFrame], warehouse: str, start: dt.date, end: dt.date
) -> dict[str, DataFrame]:
    """Clean the feeds, write dimensions, fact and feature table, return the stored tables."""
    spark = next(iter(feeds.values())).sparkSession
    tables: dict[str, DataFrame] = {}

    def write(df: DataFrame, name: str, schema=None, partition_by: list[str] | None = None) -> None:
        path = f"{warehouse}/{name}"
        if schema is None:
            create_or_replace(df, name, path, partition_by)
        else:
            replace_load(df, name, schema, path, partition_by)
        tables[name] = spark.table(name).select(*(schema.names if schema else df.columns))

    # rows outside the window never reach de-duplication or the clip bounds
    cleaned = silver.clean_all(silver.within(feeds, start, end))
    for name in ("activity", "waiting_list", "workforce", "illness", "weather", "demographics"):
        if name in cleaned:
            write(cleaned[name], f"silver_{name}")
    write(build_dim_date(spark, start, end), "dim_date", schemas.DIM_DATE)
    write(cleaned["dim_hospital"], "dim_hospital", schemas.DIM_HOSPITAL)
    write(cleaned["dim_specialty"], "dim_specialty", schemas.DIM_SPECIALTY)
    write(cleaned["dim_region"], "dim_region", schemas.DIM_REGION)
    fact = star.build_fact(
        tables["silver_activity"], tables.get("silver_waiting_list"), tables["silver_workforce"],
        tables["silver_illness"], tables["silver_weather"], tables["dim_hospital"],
    )
    write(fact, "hospital_activity_fact", schemas.FACT, ["date_key"])
    write(star.feature_table(tables["hospital_activity_fact"]), "hospital_activity_features")
    return tables


def load_increment(
    feeds: dict[str, DataFrame], warehouse: str, start: dt.date, end: dt.date, run: str, profile: silver.Profile
) -> None:
    """Load the fact's days start..end and leave all others as they are.

    `profile` holds the figures of the whole feeds (`silver.profile`), so a day's rows do not depend on the
    range they are loaded with. A run repeated under its name leaves the same table and manifest.
    """
    cleaned = silver.clean_all(silver.within(feeds, start, end), profile)
    fact = star.build_fact(
        cleaned["activity"], cleaned.get("waiting_list"), cleaned["workforce"], cleaned["illness"],
        cleaned["weather"], cleaned["dim_hospital"], with_ids=False,
    )
    numbered = star.with_day_position(store(fact, "increment"))
    increments.load_days(numbered, f"{warehouse}/{BY_DAY}", schemas.DAY_FACT, start, end, run)


def incremental_fact(spark: SparkSession, warehouse: str) -> DataFrame:
    """The fact loaded by days, its ids numbered over all days from the manifest's counts."""
    path = f"{warehouse}/{BY_DAY}"
    rows = increments.read_days(spark, path, schemas.DAY_FACT)
    placed = increments.with_day_offset(rows, increments.day_counts(spark, path))
    numbered = placed.withColumn("activity_id", (F.col("rows_before") + F.col("day_position")) * 1000 + 1)
    return numbered.select(*schemas.FACT.names)


def analyse(
    tables: dict[str, DataFrame], warehouse: str, run_date: dt.date, trees: int | None = None,
    horizons: tuple[int, ...] = (30, 60, 90),
) -> dict[str, DataFrame]:
    """Forecasts, risk, recommendations, back-test and views on stored star-schema tables."""
    fact, hospitals = tables["hospital_activity_fact"], tables["dim_hospital"]
    workforce, spark = tables["silver_workforce"], tables["hospital_activity_fact"].sparkSession

    def write(df: DataFrame, name: str, schema) -> DataFrame:
        replace_load(df, name, schema, f"{warehouse}/{name}")
        tables[name] = spark.table(name)
        return tables[name]

    forecast = training.train_all(fact, workforce, hospitals, run_date, trees, horizons)
    write(forecast, "ml_forecast", schemas.FORECAST)
    scored = write(risk.risk_table(risk.compute_risk(fact)), "risk_score", schemas.RISK)
    actions = recommend.recommendations(fact, scored, hospitals, workforce, run_date)
    write(actions, "recommendation", schemas.RECOMMENDATION)
    backtest.run_and_persist(fact, run_date, warehouse, trees=trees)
    views.register(tables)
    return tables


def run(spark: SparkSession, landing: str, warehouse: str, args: list[str], today: dt.date) -> dict[str, DataFrame]:
    start, end = date_range(args, today)
    tables = build_warehouse(landed_feeds(spark, landing), warehouse, start, end)
    return analyse(tables, warehouse, today)


def main(argv: list[str]) -> None:
    landing, warehouse, *dates = argv
    run(build_session("wardflow job"), landing, warehouse, dates, dt.date.today())
