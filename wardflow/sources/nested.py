"""Nested documents: organisation registers and weather archives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import (
    modelled_beds, organisation_name, organisation_type, region_for_postcode,
)
from ..functions.numbers import round_exact

SOURCE_LAG_DAYS = 5


def parse(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """Replace a JSON text column with its typed fields."""
    rest = [c for c in df.columns if c != col]
    typed = df.withColumn("_doc", F.from_json(col, schema.simpleString()))
    return typed.select(*rest, "_doc.*")


def flatten_organisations(
    documents: DataFrame, limit: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """One row per acute organisation: code, name, region, type, modelled capacity.

    With a limit the first organisations in register order are kept (a top-k over the page order
    and the position inside the page).
    """
    order = order or []
    rows = documents.select(*order, F.posexplode("Organisations").alias("pos", "org"))
    name = F.coalesce(F.col("org.Name"), F.lit(""))
    flat = rows.select(
        *order,
        "pos",
        F.coalesce(F.col("org.OrgId"), F.lit("")).alias("trust_code"),
        organisation_name(name).alias("trust_name"),
        region_for_postcode(F.col("org.PostCode")).alias("region_id"),
        organisation_type(name).alias("hospital_type"),
    ).filter(F.col("hospital_type") == "Acute")
    flat = flat.withColumn("bed_capacity", modelled_beds(F.col("trust_code")))
    return flat if limit is None else flat.orderBy(*order, "pos").limit(limit)


def flatten_weather(documents: DataFrame) -> DataFrame:
    """One row per region and day from parallel arrays; days without a value are dropped."""
    pairs = F.arrays_zip(
        F.col("daily.time").alias("time"), F.col("daily.temperature_2m_mean").alias("temp")
    )
    return (
        documents.select("region_id", F.explode(pairs).alias("p"))
        .filter(F.col("p.temp").isNotNull() & F.col("p.time").isNotNull())
        .select(
            F.col("p.time").cast("date").alias("date"), "region_id",
            round_exact(F.col("p.temp"), 1).alias("avg_temp_c"),
        )
    )


def within_source_lag(df: DataFrame, end: Column, today: Column | None = None, col: str = "date") -> DataFrame:
    """Only dates the archive can already hold: up to `end`, and five days before today."""
    today = F.current_date() if today is None else today
    return df.filter(F.col(col) <= F.least(end, F.date_sub(today, SOURCE_LAG_DAYS)))


def capped_window(start: dt.date, end: dt.date, today: dt.date) -> tuple[dt.date, dt.date]:
    """Request window of a lagging source; an empty window is an error."""
    end = min(end, today - dt.timedelta(days=SOURCE_LAG_DAYS))
    if start > end:
        raise ValueError("the window lies within the source's lag")
    return start, end

