"""The four analytics views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mean
from ..operators.snapshots import at_latest, top


def national_pressure(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date_key").agg(
        F.sum("ae_attendances").alias("ae_attendances"),
        F.sum("admissions").alias("admissions"),
        F.sum("discharges").alias("discharges"),
        mean(F.col("bed_occupancy_pct")).alias("avg_bed_occupancy_pct"),
        F.sum("waiting_list_size").alias("total_waiting_list"),
        mean(F.col("vacancy_rate")).alias("avg_vacancy_rate"),
    )


def with_region(risk: DataFrame, hospitals: DataFrame, regions: DataFrame) -> DataFrame:
    places = hospitals.select("hospital_id", "hospital_name", "region_id")
    return risk.join(places, "hospital_id").join(regions.select("region_id", "region_name"), "region_id")


def regional_risk_latest(risk: DataFrame, hospitals: DataFrame, regions: DataFrame) -> DataFrame:
    cls = F.col("classification")
    return (
        with_region(at_latest(risk), hospitals, regions)
        .groupBy("region_id", "region_name", "date_key")
        .agg(
            *[F.count_if(cls == c).alias(f"{c.lower()}_count") for c in ("Red", "Amber", "Green")],
            mean(F.col("score")).alias("avg_score"),
        )
    )


def forecast_long(forecast: DataFrame, hospitals: DataFrame, specialties: DataFrame) -> DataFrame:
    """Forecasts with names; national rows (no hospital) stay."""
    return (
        forecast.join(hospitals.select("hospital_id", "hospital_name"), "hospital_id", "left")
        .join(specialties.select("specialty_id", "specialty_name"), "specialty_id", "left")
        .select(
            "date_key", "hospital_name", "specialty_name", "target", "horizon_days",
            "yhat", "yhat_lower", "yhat_upper", "model",
        )
    )


def top_risk_trusts(risk: DataFrame, hospitals: DataFrame, regions: DataFrame, n: int = 10) -> DataFrame:
    named = with_region(at_latest(risk), hospitals, regions)
    return top(named, n, "score", ["hospital_id"]).select(
        "hospital_name", "region_name", "classification", "score", "date_key"
    )


def register(tables: dict[str, DataFrame]) -> None:
    """Create the temp views from the star-schema and analytics tables."""
    hospitals, regions = tables["dim_hospital"], tables["dim_region"]
    national_pressure(tables["hospital_activity_fact"]).createOrReplaceTempView("v_national_pressure")
    if "risk_score" in tables:
        risk = tables["risk_score"]
        regional_risk_latest(risk, hospitals, regions).createOrReplaceTempView("v_regional_risk_latest")
        top_risk_trusts(risk, hospitals, regions).createOrReplaceTempView("v_top_risk_trusts")
    if "ml_forecast" in tables:
        forecast_long(
            tables["ml_forecast"], hospitals, tables["dim_specialty"]
        ).createOrReplaceTempView("v_forecast_long")
