"""Serving queries over the star schema, the analytics tables and the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.codes import short_name
from ..functions.numbers import mean, round_exact, round_scaled
from ..operators.scores import shares
from ..operators.snapshots import at_latest, newest_first, top, trailing_days
from .views import with_region

CLASSES = ("Red", "Amber", "Green")


# Overview ---------------------------------------------------------------------------------------

def red_count(risk: DataFrame) -> DataFrame:
    return at_latest(risk).agg(F.count_if(F.col("classification") == "Red").alias("trusts_red"))


def kpi_row(pressure: DataFrame, risk: DataFrame) -> DataFrame:
    """Newest national row with missing values as 0, and the number of Red hospitals."""
    def whole(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)

    def one_place(c):
        return round_exact(F.coalesce(F.col(c), F.lit(0.0)), 1).alias(c)

    return pressure.orderBy(F.desc("date_key")).limit(1).select(
        F.col("date_key").cast("string").alias("latest_date"),
        whole("ae_attendances"),
        one_place("avg_bed_occupancy_pct"),
        whole("total_waiting_list"),
        one_place("avg_vacancy_rate"),
    ).withColumn("trusts_red", red_count(risk).scalar())


def pressure_last_days(pressure: DataFrame, days: int = 90) -> DataFrame:
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    return newest_first(pressure, days)


# Risk -------------------------------------------------------------------------------------------

def risk_distribution(risk: DataFrame) -> DataFrame:
    return at_latest(risk).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def class_share(risk: DataFrame) -> DataFrame:
    """Share of each class in whole percent; classes without hospitals show 0."""
    counted = at_latest(risk).agg(
        *[F.count_if(F.col("classification") == c).alias(c) for c in CLASSES]
    )
    rows = counted.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("classification"), F.col(c).alias("n")) for c in CLASSES])
        ).alias("r")
    ).select("r.*")
    return shares(rows, "classification", whole_percent=True)


def regional_shares(regional: DataFrame) -> DataFrame:
    """Class shares and colour band per region, worst mean score first."""
    total = F.coalesce(
        F.nullif(F.col("red_count") + F.col("amber_count") + F.col("green_count"), F.lit(0)), F.lit(1)
    )
    return regional.select(
        "region_id", "region_name", "avg_score",
        scoring.score_band(F.col("avg_score")).alias("band"),
        *[(F.col(f"{c.lower()}_count") / total * 100.0).alias(f"{c.lower()}_pct") for c in CLASSES],
    ).orderBy(F.desc_nulls_last("avg_score"), "region_id")


def risk_summary(risk: DataFrame, top_trusts: DataFrame, headline: int = 3) -> DataFrame:
    """The first rows of the top list next to the number of Red hospitals."""
    return top_trusts.orderBy(F.desc("score"), "hospital_name").limit(headline).withColumn(
        "n_red", red_count(risk).scalar()
    )


def risk_class_summary(risk: DataFrame) -> DataFrame:
    return risk.groupBy("classification").agg(
        F.count(F.lit(1)).alias("n"), round_scaled(mean(F.col("score")), 3).alias("avg_score")
    )


def red_in_top_list(top_trusts: DataFrame) -> DataFrame:
    """Red rows within the top list only (not all Red hospitals)."""
    return top_trusts.agg(F.count_if(F.col("classification") == "Red").alias("trusts_in_red"))


# Forecasts --------------------------------------------------------------------------------------

def forecasts(
    long: DataFrame, target: str | None = None, horizon: int | None = None, limit: int | None = None
) -> DataFrame:
    """Forecast listing with optional filters, ordered by date; whole unless a limit is given."""
    if target:
        long = long.filter(F.col("target") == target)
    if horizon:
        long = long.filter(F.col("horizon_days") == horizon)
    order = ["date_key", "target", "horizon_days", "hospital_name", "specialty_name", "yhat"]
    listed = long.orderBy(*order)
    return listed if limit is None else listed.limit(limit)


def national_forecast_line(long: DataFrame) -> DataFrame:
    """Mean forecast and band per date; missing values count as 0."""
    def average(c):
        return round_exact(mean(F.coalesce(F.col(c), F.lit(0).cast("decimal(14,2)"))), 2, ties_up=True)

    return long.groupBy("date_key").agg(
        average("yhat").alias("yhat"),
        average("yhat_lower").alias("yhat_lower"),
        average("yhat_upper").alias("yhat_upper"),
    ).orderBy("date_key")


def recent_forecast_mean(forecast: DataFrame) -> DataFrame:
    return (
        trailing_days(forecast, 7)
        .groupBy("target", "horizon_days")
        .agg(mean(F.col("yhat")).alias("yhat"))
        .orderBy("target", "horizon_days")
    )


def forecast_inventory(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("target", "horizon_days", "model").agg(
        F.count(F.lit(1)).alias("n"), round_scaled(mean(F.col("yhat")), 2).alias("avg_yhat")
    )


def horizon_comparison(forecast: DataFrame, target: str = "waiting_time") -> DataFrame:
    return forecast.filter(F.col("target") == target).groupBy("horizon_days").agg(
        round_scaled(mean(F.col("yhat")), 1).alias("mean_pred_wait_days")
    )


# Workforce --------------------------------------------------------------------------------------

def workforce_snapshot(fact: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Newest staffing per hospital, highest vacancy rate first, unknown rates last."""
    staff = at_latest(fact).groupBy("hospital_id").agg(
        F.max("staff_count").alias("staff_count"),
        F.max("vacancies").alias("vacancies"),
        F.max("vacancy_rate").alias("vacancy_rate"),
    )
    return (
        staff.join(hospitals.select("hospital_id", "hospital_name", "region_id"), "hospital_id")
        .groupBy("hospital_name", "region_id")
        .agg(*[F.max(c).alias(c) for c in ("staff_count", "vacancies", "vacancy_rate")])
        .orderBy(F.desc_nulls_last("vacancy_rate"), "hospital_name")
    )


def workforce_chart(snapshot: DataFrame, n: int = 12) -> DataFrame:
    """Top n by vacancy rate with a short label and a colour band."""
    return top(snapshot, n, "vacancy_rate", ["hospital_name"]).select(
        "*",
        short_name(F.col("hospital_name")).alias("short"),
        scoring.vacancy_band(F.col("vacancy_rate")).alias("band"),
    )


def _latest_by_name(fact: DataFrame, dim: DataFrame, key: str, name: str, aggs: dict) -> DataFrame:
    """Aggregate the newest date per dimension key first, then join the few results to names.

    aggs: output -> (kind, column). Means keep sum and count until after the join, so that two
    keys sharing one name still give one mean over all rows.
    """
    parts = []
    for out, (kind, col) in aggs.items():
        parts.append(F.sum(col).alias(f"{out}_sum"))
        parts.append(F.count(col).alias(f"{out}_n"))
    grouped = at_latest(fact).groupBy(key).agg(*parts).join(dim.select(key, name), key).groupBy(name)
    final = []
    for out, (kind, _) in aggs.items():
        total = F.sum(f"{out}_sum")
        if kind == "mean":
            total = F.try_divide(total.cast("double"), F.sum(f"{out}_n").cast("double"))
        final.append(total.alias(out))
    return grouped.agg(*final)


def vacancy_pressure(fact: DataFrame, hospitals: DataFrame, n: int = 5) -> DataFrame:
    aggs = {
        "vacancy_rate": ("mean", "vacancy_rate"),
        "vacancies": ("sum", "vacancies"),
        "staff_count": ("sum", "staff_count"),
    }
    rows = _latest_by_name(fact, hospitals, "hospital_id", "hospital_name", aggs)
    return top(rows, n, "vacancy_rate", ["hospital_name"])


# Question answering -----------------------------------------------------------------------------

def intent_wait(fact: DataFrame, specialties: DataFrame) -> DataFrame:
    rows = _latest_by_name(
        fact, specialties, "specialty_id", "specialty_name",
        {"median_wait_days": ("mean", "median_wait_days")},
    )
    return top(rows, 10, "median_wait_days", ["specialty_name"])


def intent_ae(fact: DataFrame) -> DataFrame:
    daily = fact.groupBy("date_key").agg(F.sum("ae_attendances").alias("ae_attendances"))
    return newest_first(daily, 60, ascending=False)


def intent_risk(risk: DataFrame, hospitals: DataFrame, regions: DataFrame) -> DataFrame:
    return top(with_region(at_latest(risk), hospitals, regions), 10, "score", ["hospital_id"]).select(
        "hospital_name", "region_name", "score", "classification"
    )


def intent_staff(fact: DataFrame, hospitals: DataFrame) -> DataFrame:
    return vacancy_pressure(fact, hospitals, 10).select("hospital_name", "vacancy_rate", "vacancies")


def intent_bed(fact: DataFrame) -> DataFrame:
    daily = fact.groupBy("date_key").agg(mean(F.col("bed_occupancy_pct")).alias("bed_occupancy_pct"))
    return newest_first(daily, 60, ascending=False)


# Exploration ------------------------------------------------------------------------------------

def daily_profile(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date_key").agg(
        F.sum("ae_attendances").alias("ae"), mean(F.col("bed_occupancy_pct")).alias("occ")
    )


def wait_by_specialty(fact: DataFrame, specialties: DataFrame) -> DataFrame:
    """Mean wait and summed list over all dates; the fact is aggregated before the name join."""
    return (
        fact.groupBy("specialty_id")
        .agg(
            F.sum("median_wait_days").alias("w"), F.count("median_wait_days").alias("n"),
            F.sum("waiting_list_size").alias("l"),
        )
        .join(specialties.select("specialty_id", "specialty_name"), "specialty_id")
        .groupBy("specialty_name")
        .agg(
            F.try_divide(F.sum("w").cast("double"), F.sum("n").cast("double")).alias("avg_wait"),
            F.sum("l").alias("list"),
        )
        .orderBy(F.desc_nulls_last("avg_wait"), "specialty_name")
    )


# Listings ---------------------------------------------------------------------------------------

def recommendation_list(recs: DataFrame, hospitals: DataFrame, ranked: bool = False) -> DataFrame:
    """Recommendations with names. Severity sorts by name (Medium first); ranked puts High first."""
    severity = scoring.severity_order(F.col("severity")) if ranked else F.col("severity")
    return recs.join(hospitals.select("hospital_id", "hospital_name"), "hospital_id", "left").select(
        *recs.columns, "hospital_name"
    ).orderBy(severity.desc(), "recommendation_id")


def validation_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "target", "model", "accuracy", "mae", "mape", "n_eval", "holdout_days",
        scoring.accuracy_band(F.col("accuracy")).alias("band"),
    )


def validation_series(series: DataFrame) -> DataFrame:
    return series.select("target", "date", "actual", "predicted").orderBy("date")


# BI measures ------------------------------------------------------------------------------------

def pressure_measures(pressure: DataFrame) -> DataFrame:
    return at_latest(pressure).agg(
        F.avg("avg_bed_occupancy_pct").alias("capacity_pressure_pct"),
        F.sum("total_waiting_list").alias("total_waiting_list"),
        F.sum("ae_attendances").alias("ae_attendances"),
    )


def live_measures(department: DataFrame) -> DataFrame:
    return at_latest(department, "minute_ts").agg(
        F.avg("occupancy_pct").alias("live_occupancy_pct"),
        F.sum("ambulances_waiting").alias("ambulances_waiting"),
        F.sum("available_beds").alias("beds_available_now"),
        F.sum("queue_length").alias("patients_queued_now"),
    )


def model_accuracy(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("accuracy").alias("model_accuracy_pct"))


def entitled(df: DataFrame, entitlement: DataFrame, email: str, region: str = "region_id") -> DataFrame:
    """Rows of the regions a user may see."""
    allowed = entitlement.filter(F.col("email") == email).select(F.col("region_id").alias(region))
    return df.join(allowed, region, "left_semi")
