"""Row-based features per series: rolling means, lags, growth, leads, fills.

A series is one (hospital, specialty) or (trust, role) at the day grain, whose primary key allows
one row per day, so a window partition grows with the calendar and not with the table. For finer
series (minutes, single events) give `block_rows`: the series is then cut into overlapping blocks
that give the same numbers, so that one long series is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.calendar import add_seasonal, is_flu_season
from ..functions.numbers import ratio
from .positions import blocked, with_position

SERIES = ["hospital_id", "specialty_id"]


def series_window(keys: list[str] | None = None, order: list[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*(keys or SERIES)).orderBy(*(order or ["date_key"]))


def rolling_mean(col: str, rows: int, w: WindowSpec) -> Column:
    """Trailing mean over rows; NULLs are skipped, short histories use what there is."""
    return F.avg(F.col(col).cast("double")).over(w.rowsBetween(-(rows - 1), Window.currentRow))


def rolling_columns(col: str, w: WindowSpec, windows=(7, 14, 30)) -> dict[str, Column]:
    return {f"{col}_roll{n}": rolling_mean(col, n, w) for n in windows}


def lag_columns(col: str, w: WindowSpec, lags=(1, 7, 14, 30)) -> dict[str, Column]:
    return {f"{col}_lag{n}": F.lag(col, n).over(w) for n in lags}


def growth_columns(col: str, w: WindowSpec, periods=(7, 30)) -> dict[str, Column]:
    """(x - earlier) / earlier, NULL where the earlier value is zero."""
    out = {}
    for n in periods:
        earlier = F.lag(col, n).over(w)
        out[f"{col}_growth{n}d"] = ratio(F.col(col) - earlier, earlier)
    return out


def add_rolling_means(df: DataFrame, col: str, windows=(7, 14, 30), keys=None, order=None) -> DataFrame:
    return df.withColumns(rolling_columns(col, series_window(keys, order), windows))


def add_lag_features(df: DataFrame, col: str, lags=(1, 7, 14, 30), keys=None, order=None) -> DataFrame:
    return df.withColumns(lag_columns(col, series_window(keys, order), lags))


def add_growth_rate(df: DataFrame, col: str, periods=(7, 30), keys=None, order=None) -> DataFrame:
    return df.withColumns(growth_columns(col, series_window(keys, order), periods))


def add_lead(df: DataFrame, col: str, rows: int, name: str = "target", keys=None, order=None) -> DataFrame:
    """Value `rows` rows ahead; rows without one are dropped."""
    ahead = F.lead(col, rows).over(series_window(keys, order))
    return df.withColumn(name, ahead).filter(F.col(name).isNotNull())


def forward_fill(df: DataFrame, cols: list[str], keys=None, order=None, default: float | None = 0.0) -> DataFrame:
    """Last known value within the series, then a default."""
    w = series_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    if default is not None:
        filled = {c: F.coalesce(v, F.lit(default)) for c, v in filled.items()}
    return df.withColumns(filled)


def add_all(df: DataFrame, targets: list[str]) -> DataFrame:
    """Seasonal, rolling, lag and growth features of several targets in one window pass."""
    w = series_window()
    columns: dict[str, Column] = {}
    for t in targets:
        columns |= rolling_columns(t, w) | lag_columns(t, w) | growth_columns(t, w)
    return add_seasonal(df).withColumns(columns)


def waiting_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features of the waiting-time model; returns the frame and its feature columns."""
    w = series_window()
    columns: dict[str, Column] = {}
    for c in ("median_wait_days", "referrals", "vacancy_rate"):
        if c in df.columns:
            columns |= lag_columns(c, w) | rolling_columns(c, w)
    d = F.col("date_key")
    columns |= {"month": F.month(d), "dow": F.weekday(d), "flu_season": is_flu_season(d).cast("int")}
    known = [c for c in ("flu_index", "covid_index", "avg_temp_c") if c in df.columns]
    return df.withColumns(columns), [*columns, *known]


def workforce_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features of the workforce models per trust and role."""
    w = series_window(["trust_code", "role"])
    columns: dict[str, Column] = {}
    for c in ("vacancy_rate", "staff_count"):
        if c in df.columns:
            columns |= lag_columns(c, w, (7, 14, 30)) | rolling_columns(c, w, (14, 30))
    d = F.col("date_key")
    columns |= {"month": F.month(d), "dow": F.weekday(d)}
    return df.withColumns(columns), [*columns]


def add_rolling_blocked(
    df: DataFrame, col: str, by: list[str], levels: list[list[str]], windows=(7, 14, 30),
    lags=(1, 7, 14, 30), block_rows: int = 100_000,
) -> DataFrame:
    """Rolling means and lags of series too long for one task.

    Rows are numbered without sorting the series as a whole, then windows run inside blocks that
    carry a halo of the preceding rows.
    """
    halo = max([*[n - 1 for n in windows], *lags])
    numbered = with_position(df, levels, by, "_position")
    wide, keys, own = blocked(numbered, by, "_position", block_rows, halo)
    w = series_window(keys, ["_position"])
    out = wide.withColumns(rolling_columns(col, w, windows) | lag_columns(col, w, lags))
    return out.filter(own).drop("_own", "_block", "_position")


def known_lag(future: DataFrame, history: DataFrame, value: str, days: int, last: Column) -> DataFrame:
    """Lag of future dates: history `days` earlier where known, else the last known value."""
    name = f"{value}_lag{days}"
    past = history.select(
        F.date_add("date_key", days).alias("date_key"), F.col(value).cast("double").alias(name)
    )
    return future.join(past, "date_key", "left").withColumn(name, F.coalesce(F.col(name), last))


def known_rolling(df: DataFrame, value: str, days: int, last: Column) -> Column:
    """Mean of known values in the `days` days before a date, else the last known value.

    `df` is one national series: one row per date (history and future, future values NULL), so
    the single window partition is as long as the calendar.
    """
    day_number = F.unix_date("date_key")
    w = Window.partitionBy(F.lit(0)).orderBy(day_number).rangeBetween(-days, -1)
    return F.coalesce(F.avg(value).over(w), last)
