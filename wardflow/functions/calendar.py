"""Calendar expressions and the date dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Months of each season and of the influenza season.
WINTER, SPRING, SUMMER = (12, 1, 2), (3, 4, 5), (6, 7, 8)
FLU_MONTHS = (10, 11, 12, 1, 2, 3)


def season(d: Column) -> Column:
    m = F.month(d)
    return (
        F.when(m.isin(*WINTER), "Winter")
        .when(m.isin(*SPRING), "Spring")
        .when(m.isin(*SUMMER), "Summer")
        .otherwise("Autumn")
    )


def is_flu_season(d: Column) -> Column:
    return F.month(d).isin(*FLU_MONTHS)


def day(ts: Column) -> Column:
    """Timestamp floored to its day."""
    return F.date_trunc("DAY", ts)


def minute(ts: Column) -> Column:
    return F.date_trunc("MINUTE", ts.cast("timestamp"))


def year_month(d: Column) -> Column:
    return F.substring(d.cast("date").cast("string"), 1, 7)


def period_month(p: Column) -> Column:
    return F.substring(p, 1, 7)


def parse_date(c: Column) -> Column:
    """Unparsable dates become NULL."""
    return c.try_cast("date")


def parse_date_strict(c: Column) -> Column:
    """Unparsable dates raise (ANSI cast)."""
    return c.cast("date")


def date_dimension(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per day between the bounds of a one-row frame, both ends included."""
    d = F.col("date_key")
    days = bounds.select(
        F.explode(
            F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("INTERVAL 1 DAY"))
        ).alias("date_key")
    )
    return days.select(
        "date_key",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week"),
        (F.weekday(d) + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        season(d).alias("season"),
        is_flu_season(d).alias("flu_season_flag"),
    )


def build_dim_date(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    bounds = spark.range(1).select(
        F.lit(str(start)).cast("date").alias("start"), F.lit(str(end)).cast("date").alias("end")
    )
    return date_dimension(bounds)


def add_seasonal(df: DataFrame, date_col: str = "date_key") -> DataFrame:
    """month, day_of_week (0 = Monday), is_weekend, ISO week."""
    d = F.col(date_col)
    return df.withColumns(
        {
            "month": F.month(d),
            "day_of_week": F.weekday(d),
            "is_weekend": F.weekday(d) >= 5,
            "weekofyear": F.weekofyear(d),
        }
    )


def seasonal_index(d: Column, peak_month: int, amplitude: float, base: float) -> Column:
    """Triangular yearly curve with its peak in one month, used for future exogenous values."""
    gap = F.abs(F.month(d) - peak_month)
    gap = F.least(gap, F.lit(12) - gap)
    return F.lit(base) + F.lit(amplitude) * F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(6.0))


def seasonal_temperature(d: Column) -> Column:
    return F.lit(10.0) + F.lit(10.0) * (F.lit(1.0) - F.abs(F.month(d) - 7) / F.lit(6.0))
