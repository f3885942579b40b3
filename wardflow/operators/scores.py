"""Z-scores, error metrics and small statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_even, round_exact, to_number
from ..functions.scoring import Z_LIMIT, zscore
from ..sources.layers import store
from .moments import pairwise_moments, pearson
from .quantiles import exact_quantiles


def peer_zscores(df: DataFrame, cols: list[str], limit: float = Z_LIMIT) -> DataFrame:
    """<col>_z against the mean and population deviation of all rows, clipped.

    The statistics are one row of partial aggregates, read as a scalar subquery.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_avg") for c in cols],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
        ).alias("stats")
    )
    s = F.col("_stats")
    z = {f"{c}_z": zscore(F.col(c), s[f"{c}_avg"], s[f"{c}_std"], limit) for c in cols}
    return df.withColumn("_stats", stats.scalar()).withColumns(z).drop("_stats")


def regional_zscores(df: DataFrame, cols: list[str], by: str = "region_id") -> DataFrame:
    """<col>_regional_z = (x - mean) / sample deviation within a region, NULL without spread.

    Aggregate plus join instead of a window: there are few regions, so a window would sort a
    third of the table in one task. The statistics are stored first, so that the planner knows
    their true size: a small table is broadcast and `df` is not shuffled at all.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    stats = df.groupBy(by).agg(
        *[F.avg(x[c]).alias(f"_{c}_avg") for c in cols],
        *[F.stddev_samp(x[c]).alias(f"_{c}_std") for c in cols],
    )
    z = {
        f"{c}_regional_z": F.try_divide(
            x[c] - F.col(f"_{c}_avg"), F.nullif(F.col(f"_{c}_std"), F.lit(0.0))
        )
        for c in cols
    }
    joined = df.join(store(stats, "regional_stats"), by, "left").withColumns(z)
    return joined.select(*df.columns, *z)


def error_scores(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, MAPE (percent), accuracy and rows scored; zero or missing actuals are left out."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    ok = a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p) & (a != 0)
    error = F.when(ok, F.abs(a - p))
    relative = F.when(ok, F.abs(F.try_divide(a - p, a)))
    mape = F.avg(relative) * 100
    return df.groupBy(*by).agg(
        round_exact(F.avg(error), 2).alias("mae"),
        round_exact(mape, 2).alias("mape"),
        round_exact(F.greatest(F.lit(0.0), F.lit(100.0) - mape), 1).alias("accuracy"),
        F.count(error).alias("n_eval"),
    ).withColumn("accuracy", F.when(F.col("n_eval") > 0, F.col("accuracy")))


def mean_errors(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE and MAPE as a fraction over all rows."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.agg(
        F.avg(F.abs(a - p)).alias("mae"), F.avg(F.abs(F.try_divide(a - p, a))).alias("mape")
    )


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max: one row per metric."""
    df = df.select(*[to_number(F.col(c)).alias(c) for c in cols])
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("metric"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
                *[F.lit(quartiles[c][p]).cast("double").alias(n)
                  for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))],
                F.max(c).alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    return stats.select(F.explode(F.array(*cols)).alias("s")).select("s.*")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair on rows where both are known, in one pass."""
    pairs = list(combinations(cols, 2))
    wanted = df.sparkSession.createDataFrame(pairs, "x string, y string")
    found = pairwise_moments(df.select(*[to_number(F.col(c)).alias(c) for c in cols]), cols)
    return wanted.join(found, ["x", "y"], "left").select("x", "y", (round_even(pearson(), 2) + 0.0).alias("r"))


def shares(df: DataFrame, label: str, n: str = "n", whole_percent: bool = False) -> DataFrame:
    """Count and percentage share per label; an empty total counts as 1."""
    total = df.agg(F.coalesce(F.nullif(F.sum(n), F.lit(0)), F.lit(1)).alias("t"))
    pct = F.lit(100.0) * F.col(n) / total.scalar()
    return df.select(label, n, (F.floor(pct + 0.5).cast("long") if whole_percent else pct).alias("share_pct"))


def trend_and_weekday(df: DataFrame, day: str, value: str) -> DataFrame:
    """Fitted daily baseline: linear trend plus the mean residual of the weekday."""
    t = F.unix_date(F.col(day)).cast("double")
    line = df.agg(
        F.struct(
            F.regr_slope(F.col(value), t).alias("slope"),
            F.regr_intercept(F.col(value), t).alias("intercept"),
        ).alias("line")
    ).scalar()
    trend = df.withColumn("_line", line).withColumn(
        "_trend", F.col("_line.slope") * t + F.col("_line.intercept")
    )
    effect = trend.groupBy(F.weekday(day).alias("_dow")).agg(
        F.avg(F.col(value) - F.col("_trend")).alias("_effect")
    )
    return (
        trend.withColumn("_dow", F.weekday(day))
        .join(effect, "_dow", "left")
        .select(*df.columns, (F.col("_trend") + F.col("_effect")).alias("baseline"))
    )
