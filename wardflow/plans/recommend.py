"""Rule-based recommendations for hospitals that are not Green."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.numbers import mean, no_decimal, one_decimal
from ..functions.scoring import recommendation_severity
from ..operators.cleaning import project
from ..operators.dedup import keep_latest
from ..operators.positions import with_range_position
from ..operators.snapshots import at_latest
from .risk import growth_30d

# Rule categories, limits, sentences and expected effects.
RULES = (
    (
        "Staffing", "vacancy_rate", 9.0,
        "Trust %s has a %s%% vacancy rate. Open international recruitment + bank incentive shifts; "
        "prioritise the %s role.",
        ("hospital_id", "vacancy_rate_text", "top_role"),
        "Reduce vacancy rate by ~3pp in 60 days.",
    ),
    (
        "Capacity", "bed_occupancy_pct", 92.0,
        "Bed occupancy at %s%% — open 8–12 surge beds and review discharge pathway for the "
        "5 longest-stay patients.",
        ("bed_occupancy_text",),
        "Drop occupancy below 90% within 14 days.",
    ),
    (
        "Workload", "waiting_list_growth_30d", 0.08,
        "Waiting list grew %s%% in 30 days. Redistribute elective lists to partner trusts and "
        "extend weekend clinics.",
        ("waiting_list_growth_text",),
        "Stabilise list size within 45 days.",
    ),
    (
        "Pathway", "ae_surge_index", 0.2,
        "A&E attendances %s%% above 7-day baseline. Activate same-day emergency care unit and "
        "divert ambulatory cases to urgent treatment centres.",
        ("ae_surge_text",),
        "Restore A&E flow to baseline within 7 days.",
    ),
)
DEFAULT_ROLE = "Nursing"


def hospital_means(fact: DataFrame) -> DataFrame:
    """Mean occupancy, vacancy rate and attendances per hospital on the newest date."""
    return at_latest(fact).groupBy("hospital_id").agg(
        mean(F.col("bed_occupancy_pct")).alias("bed_occupancy_pct"),
        mean(F.col("vacancy_rate")).alias("vacancy_rate"),
        mean(F.col("ae_attendances")).alias("ae_attendances"),
    )


def json_metric_mean(risk: DataFrame, metric: str = "ae_surge_index") -> DataFrame:
    """Mean of one number inside the JSON column, per hospital over all dates."""
    value = F.from_json("components_json", f"{metric} double")[metric]
    return risk.groupBy("hospital_id").agg(F.avg(value).alias(metric))


def top_roles(workforce: DataFrame) -> DataFrame:
    """Role with the highest vacancy rate per trust; ties go to the first name."""
    best = F.min_by("role", F.struct(-F.col("vacancy_rate"), F.col("role")))
    return (
        workforce.filter(F.col("vacancy_rate").isNotNull())
        .groupBy("trust_code")
        .agg(best.alias("top_role"))
    )


def at_risk(risk: DataFrame) -> DataFrame:
    return risk.filter(F.col("classification") != "Green")


def rule_inputs(fact: DataFrame, risk: DataFrame, hospitals: DataFrame, workforce: DataFrame) -> DataFrame:
    """Newest risk row per hospital with the raw metrics the rules look at."""
    newest = keep_latest(
        risk.select("hospital_id", "date_key", "classification"), ["hospital_id"], ["date_key"]
    )
    df = (
        newest.drop("date_key")
        .join(hospital_means(fact), "hospital_id", "left")
        .join(json_metric_mean(risk), "hospital_id", "left")
        .join(growth_30d(fact), "hospital_id", "left")
        .join(hospitals.select("hospital_id", "trust_code"), "hospital_id", "left")
        .join(top_roles(workforce), "trust_code", "left")
    )
    numbers = ("bed_occupancy_pct", "vacancy_rate", "ae_surge_index", "waiting_list_growth_30d")
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in numbers})
    return df.withColumns(
        {
            "vacancy_rate_text": one_decimal(F.col("vacancy_rate")),
            "bed_occupancy_text": one_decimal(F.col("bed_occupancy_pct")),
            "waiting_list_growth_text": one_decimal(F.col("waiting_list_growth_30d") * 100),
            "ae_surge_text": no_decimal(F.col("ae_surge_index") * 100),
            "top_role": F.coalesce(F.col("top_role"), F.lit(DEFAULT_ROLE)),
        }
    )


def _hit(rank: int) -> Column:
    category, metric, limit, sentence, args, impact = RULES[rank]
    return F.when(
        F.col(metric) > limit,
        F.struct(
            F.lit(rank).alias("rank"),
            F.lit(category).alias("category"),
            F.format_string(sentence, *[F.col(a) for a in args]).alias("action"),
            F.lit(impact).alias("expected_impact"),
        ),
    )


def rule_hits(inputs: DataFrame) -> DataFrame:
    """One row per hospital and rule that fires (at most one row per rule)."""
    hits = F.array_compact(F.array(*[_hit(i) for i in range(len(RULES))]))
    return (
        at_risk(inputs)
        .withColumn("severity", recommendation_severity(F.col("classification")))
        .withColumn("hit", F.explode(hits))
        .select("*", "hit.*")
        .drop("hit")
    )


def recommendations(
    fact: DataFrame, risk: DataFrame, hospitals: DataFrame, workforce: DataFrame, run_date: dt.date | str
) -> DataFrame:
    """Recommendation rows stamped with the given run date, numbered by hospital and rule."""
    hits = rule_hits(rule_inputs(fact, risk, hospitals, workforce))
    hits = hits.withColumn("date_key", F.lit(str(run_date)).cast("date"))
    numbered = with_range_position(hits, ["hospital_id", "rank"], name="recommendation_id")
    return project(numbered, schemas.RECOMMENDATION)
