"""Risk classes, bands and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_even

# Weights and limits of the composite risk score.
WEIGHT_OCCUPANCY = 0.30
WEIGHT_WAITING = 0.30
WEIGHT_VACANCY = 0.25
WEIGHT_SURGE = 0.15
Z_LIMIT = 3.0
RED_OCCUPANCY, RED_VACANCY = 95.0, 15.0
AMBER_OCCUPANCY, AMBER_VACANCY = 92.0, 12.0
CLASSES = ("Green", "Amber", "Red")


def relative_class(score: Column) -> Column:
    """Peer-relative verdict. A missing or NaN score is Red."""
    return F.when(score < 0.0, "Green").when(score < 1.0, "Amber").otherwise("Red")


def absolute_class(occupancy: Column, vacancy: Column) -> Column:
    """Safety-limit verdict. Missing inputs (NULL, not NaN) do not breach a limit."""
    return (
        F.when((occupancy >= RED_OCCUPANCY) | (vacancy >= RED_VACANCY), "Red")
        .when((occupancy >= AMBER_OCCUPANCY) | (vacancy >= AMBER_VACANCY), "Amber")
        .otherwise("Green")
    )


def severity_rank(verdict: Column) -> Column:
    return F.when(verdict == "Red", 2).when(verdict == "Amber", 1).otherwise(0)


def worse_of(a: Column, b: Column) -> Column:
    return F.when(severity_rank(a) >= severity_rank(b), a).otherwise(b)


def composite(occupancy_z: Column, waiting_z: Column, vacancy_z: Column, surge_z: Column) -> Column:
    weighted = (
        F.lit(WEIGHT_OCCUPANCY) * occupancy_z
        + F.lit(WEIGHT_WAITING) * waiting_z
        + F.lit(WEIGHT_VACANCY) * vacancy_z
        + F.lit(WEIGHT_SURGE) * surge_z
    )
    return round_even(weighted, 3)


def zscore(x: Column, avg: Column, std: Column, limit: float | None = None) -> Column:
    """(x - avg) / std. Without spread every z-score is 0; an optional limit clips both sides."""
    z = F.when((std == 0) | std.isNull() | F.isnan(std), F.lit(0.0)).otherwise(
        F.try_divide(x - avg, std)
    )
    if limit is None:
        return z
    return F.when(z > limit, F.lit(limit)).when(z < -limit, F.lit(-limit)).otherwise(z)


def recommendation_severity(verdict: Column) -> Column:
    return F.when(verdict == "Red", "High").otherwise("Medium")


def severity_order(severity: Column) -> Column:
    """Clinical order of severities (their names sort the other way round)."""
    return F.when(severity == "High", 2).when(severity == "Medium", 1).otherwise(0)


def score_band(score: Column) -> Column:
    return F.when(score >= 1, "Red").when(score >= 0, "Amber").otherwise("Green")


def vacancy_band(rate: Column) -> Column:
    return F.when(rate >= 12, "Red").when(rate >= 8, "Amber").otherwise("Green")


def accuracy_band(accuracy: Column) -> Column:
    return F.when(accuracy >= 85, "Green").when(accuracy >= 70, "Amber").otherwise("Red")


def shortage_label(vacancy_rate: Column) -> Column:
    return F.coalesce((vacancy_rate > 9.0).cast("int"), F.lit(0))
