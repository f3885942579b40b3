"""Star schema: dimensions, the daily activity fact and its feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import period_month, year_month
from ..functions.numbers import mean, percent, sum_or_zero
from ..operators import quality
from ..operators.cleaning import project
from ..operators.dedup import distinct_pairs
from ..operators.positions import with_position
from ..operators.scores import regional_zscores
from ..operators.windows import add_all


def workforce_totals(workforce: DataFrame) -> DataFrame:
    return (
        workforce.filter(F.col("trust_code").isNotNull())
        .groupBy("trust_code")
        .agg(
            sum_or_zero(F.col("staff_count")).alias("staff_count"),
            sum_or_zero(F.col("vacancies")).alias("vacancies"),
        )
        .withColumn("vacancy_rate", percent(F.col("vacancies"), F.col("staff_count")))
    )


def monthly_waiting(waiting: DataFrame) -> DataFrame:
    month = period_month(F.col("period")).alias("ym")
    return (
        waiting.filter(F.col("trust_code").isNotNull() & F.col("specialty_id").isNotNull())
        .groupBy("trust_code", "specialty_id", month)
        .agg(
            sum_or_zero(F.col("waiting_list_size")).alias("waiting_list_size"),
            mean(F.col("median_wait_days")).alias("median_wait_days"),
        )
    )


def bed_capacity(hospitals: DataFrame) -> DataFrame:
    return hospitals.groupBy("trust_code").agg(sum_or_zero(F.col("bed_capacity")).alias("bed_capacity"))


def bridge_months(daily: DataFrame, waiting: DataFrame | None) -> DataFrame:
    """Repeat the monthly waiting list on every day of its month; NULL columns without a feed."""
    if waiting is None:
        return daily.withColumns(
            {
                "waiting_list_size": F.lit(None).cast("bigint"),
                "median_wait_days": F.lit(None).cast("double"),
            }
        )
    keys = ["trust_code", "specialty_id", "ym"]
    by_month = daily.withColumn("ym", year_month(F.col("date_key")))
    return by_month.join(monthly_waiting(waiting), keys, "left").drop("ym")


def build_fact(
    activity: DataFrame,
    waiting: DataFrame | None,
    workforce: DataFrame,
    illness: DataFrame,
    weather: DataFrame,
    hospitals: DataFrame,
    with_ids: bool = True,
) -> DataFrame:
    """The 19-column fact as one lazy plan.

    Ids are numbered right after the hospital bridge, which fixes their order, on the narrow rows of the
    activity; numbering reads these twice, so pass a stored activity. Everything else is joined later.

    Right sides that are aggregated or distinct on their join key let the optimizer drop the
    joins a query does not use. No broadcast is forced: small sides are broadcast by their
    measured size, large ones shuffle and AQE splits skewed partitions.
    """
    fact = activity.withColumnRenamed("date", "date_key")
    fact = fact.join(distinct_pairs(hospitals, "trust_code", "hospital_id"), "trust_code", "left")
    if with_ids:
        fact = with_activity_ids(fact)
    fact = fact.join(distinct_pairs(hospitals, "trust_code", "region_id"), "trust_code", "left")
    fact = fact.join(workforce_totals(workforce), "trust_code", "left")
    fact = bridge_months(fact, waiting)
    fact = fact.join(
        illness.select(F.col("date").alias("date_key"), "flu_index", "covid_index"), "date_key", "left"
    )
    temperatures = weather.filter(F.col("region_id").isNotNull()).select(
        F.col("date").alias("date_key"), "region_id", "avg_temp_c"
    )
    fact = fact.join(temperatures, ["date_key", "region_id"], "left")
    fact = fact.join(bed_capacity(hospitals), "trust_code", "left").withColumn(
        "bed_occupancy_pct", percent(F.col("bed_occupancy_count"), F.col("bed_capacity"))
    )
    return project(fact, schemas.FACT)


def with_activity_ids(fact: DataFrame) -> DataFrame:
    """activity_id = position * 1000 + 1 in the order date, hospital, specialty.

    Rows of an unknown hospital are numbered too, so the key is made non-NULL first.
    """
    keys = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in ("hospital_id", "specialty_id")}
    levels = [["date_key"], ["_hospital_id"], ["_specialty_id"]]
    numbered = with_position(fact.withColumns(keys), levels, name="_p")
    return numbered.withColumn("activity_id", F.col("_p") * 1000 + 1).drop("_p", *keys)


def with_day_position(fact: DataFrame) -> DataFrame:
    """Position of each row within its day, in the order hospital, specialty. Pass a stored fact."""
    keys = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in ("hospital_id", "specialty_id")}
    numbered = with_position(fact.withColumns(keys), [["_hospital_id"], ["_specialty_id"]], ["date_key"], "day_position")
    return numbered.drop(*keys)


def feature_table(fact: DataFrame) -> DataFrame:
    """Engineered features next to the fact, which keeps its 19 columns. Pass a stored fact."""
    scored = regional_zscores(fact, ["bed_occupancy_pct", "median_wait_days"])
    return add_all(scored, ["bed_occupancy_pct", "waiting_list_size"])


def integrity_report(
    fact: DataFrame, dim_date: DataFrame, hospitals: DataFrame, specialties: DataFrame, regions: DataFrame
) -> DataFrame:
    """Violations of the keys, references and completeness the star schema promises."""
    return quality.report(
        [
            quality.not_empty(fact, "fact is empty"),
            quality.not_null(fact, ["date_key", "hospital_id", "specialty_id", "region_id"], "fact NULL keys"),
            quality.unique(fact, ["date_key", "hospital_id", "specialty_id"], "fact duplicate grain"),
            quality.foreign_key(fact, dim_date, "date_key", "fact without date"),
            quality.foreign_key(fact, hospitals, "hospital_id", "fact without hospital"),
            quality.foreign_key(fact, specialties, "specialty_id", "fact without specialty"),
            quality.foreign_key(fact, regions, "region_id", "fact without region"),
            quality.unique(hospitals, ["hospital_id"], "duplicate hospital"),
            quality.one_to_one(hospitals, "trust_code", "hospital_id", "trust with several hospitals"),
            quality.gap_free(dim_date, "missing calendar days"),
        ]
    )
