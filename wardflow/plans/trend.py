"""Trend, seasons and holidays of one daily series, with bands that widen.

The series gets a piecewise linear trend, weekday, yearly and holiday terms. One aggregate gives the sums
of products of all terms; the rest is a small solve. Each coefficient has a prior: changes of slope a narrow
Laplace one, so that few stand out, seasons a wide normal one. A band adds up the noise, the variance of
the coefficients, and that of slope changes still to come at the rate and size of the past ones, which
grows with the third power of the time ahead.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.moments import gram

CHANGEPOINTS, HISTORY = 25, 0.8  # slopes may change in the first 80 % of the history
CHANGE_SCALE, SLOPE_SCALE, SEASON_SCALE = 0.05, 5.0, 10.0
BAND_Z = 1.2816  # 80 % band of a normal error

# Public holidays with a fixed day (month, day) and moving ones as days after Easter.
FIXED_HOLIDAYS = ((1, 1), (12, 25), (12, 26))
EASTER_OFFSETS = (-2, 1)


class TooLittleHistory(ValueError):
    """No row is left to fit a model on."""


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def holidays(first: int, last: int) -> list[dt.date]:
    days = []
    for y in range(first, last + 1):
        days += [dt.date(y, m, d) for m, d in FIXED_HOLIDAYS]
        days += [easter(y) + dt.timedelta(days=o) for o in EASTER_OFFSETS]
        may = dt.date(y, 5, 1)
        days.append(may + dt.timedelta(days=-may.weekday() % 7))
        for month in (5, 8):
            end = dt.date(y, month, 31)
            days.append(end - dt.timedelta(days=end.weekday()))
    return days


def calendar_features(
    days: DataFrame, start: dt.date, end: dt.date, yearly: bool = True
) -> tuple[DataFrame, list[str]]:
    """Trend with changepoints over the first 80 % of the history, weekday, Fourier and holiday terms.

    The yearly season is fitted on any history; `yearly` leaves it out.
    """
    span = max((end - start).days, 1)
    d = F.col("date_key")
    t = F.datediff(d, F.lit(start)) / F.lit(float(span))
    columns: dict[str, Column] = {"t": t}
    for i in range(1, CHANGEPOINTS + 1):
        columns[f"t_{i}"] = F.greatest(F.lit(0.0), t - HISTORY * i / (CHANGEPOINTS + 1))
    for i in range(6):
        columns[f"dow_{i}"] = (F.weekday(d) == i).cast("double")
    if yearly:
        angle = F.dayofyear(d) * F.lit(2 * math.pi / 365.25)
        for k in (1, 2, 3):
            columns[f"sin_{k}"], columns[f"cos_{k}"] = F.sin(angle * k), F.cos(angle * k)
    free = holidays(start.year, end.year + 1)
    columns["holiday"] = d.isin(free).cast("double")
    return days.withColumns(columns), list(columns)


def solve(products: np.ndarray, n: int, change: np.ndarray, scales: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, their covariance, noise variance) from the sums of products of terms, target last.

    `scales` are the prior scales of the coefficients (inf for none). Those of `change` are Laplace, met
    by reweighting normal ones until they stay; the noise is that of what the fit leaves. A fit that leaves
    no more than the rounding of the sums is final.
    """
    a, b, yy = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    precision = 1 / scales**2
    noise = max(yy / n, 1e-12)
    floor = 1e-12 * noise
    beta = np.zeros(len(b))
    for _ in range(200):
        inverse = np.linalg.pinv(a + noise * np.diag(precision), hermitian=True)
        before, beta = beta, inverse @ b
        left = max(yy - 2 * beta @ b + beta @ a @ beta, 0.0)
        free = max(n - np.trace(inverse @ a), 1.0)
        noise = max(left / free, floor)
        if noise == floor:  # only rounding is left, which more rounds would blow up
            exact = a + noise * np.diag(precision)
            unit = 1 / np.sqrt(np.maximum(exact.diagonal(), 1e-300))
            inverse = np.linalg.pinv(exact * np.outer(unit, unit), hermitian=True) * np.outer(unit, unit)
            break
        size = np.maximum(np.abs(beta[change]), 1e-4 * scales[change])
        precision[change] = 1 / (scales[change] * size)
        if np.abs(beta - before).max() <= 1e-9 * max(np.abs(beta).max(), 1e-9):
            break
    return beta, noise * inverse, noise


@dataclass
class Baseline:
    """A fitted series; coefficients are those of `names` and, last, the level."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    noise: float
    start: dt.date
    end: dt.date
    multiplicative: bool
    yearly: bool = True

    @property
    def changes(self) -> np.ndarray:
        """Changes of the slope at the changepoints."""
        return self.coefficients[[i for i, c in enumerate(self.names) if c.startswith("t_")]]

    def predict(self, days: DataFrame) -> DataFrame:
        """The days with yhat, yhat_lower, yhat_upper."""
        x, names = calendar_features(days, self.start, self.end, self.yearly)
        schema = T.StructType([*days.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("yhat", "yhat_lower", "yhat_upper")]])
        arrow, width = to_arrow_schema(schema), len(days.columns)
        beta, covariance, noise = self.coefficients, self.covariance, self.noise
        growth = 2 * float(np.abs(self.changes).mean()) ** 2 * CHANGEPOINTS / HISTORY / 3
        back = np.exp if self.multiplicative else np.asarray

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[width:]]
                rows = np.column_stack([*terms, np.ones(batch.num_rows)])
                ahead = np.maximum(rows[:, 0] - 1, 0)
                middle = rows @ beta
                spread = np.einsum("ij,jk,ik->i", rows, covariance, rows)
                half = BAND_Z * np.sqrt(np.maximum(spread, 0) + noise + growth * ahead**3)
                out = [pa.array(back(v)) for v in (middle, middle - half, middle + half)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns[:width], *out], arrow)], schema=arrow)

        return x.select(*days.columns, *names).mapInArrow(run, schema)


def fit_baseline(daily: DataFrame, value: str, multiplicative: bool = False, yearly: bool = True) -> Baseline:
    """Fit on (date_key, value); a log target makes the seasons multiplicative.

    Days without a value, and for a log target those not above zero, are left out.
    """
    daily = daily.filter(F.col(value).isNotNull())
    if multiplicative:
        daily = daily.filter(F.col(value) > 0)
    start, end = daily.agg(F.min("date_key"), F.max("date_key")).first()
    if start is None:
        raise TooLittleHistory(f"no rows to fit {value} on")
    y = F.log(value) if multiplicative else F.col(value).cast("double")
    x, names = calendar_features(daily.withColumn("_y", y), start, end, yearly)
    n, sums = gram(x, [*names, "_y"])
    order = [*range(len(names)), len(names) + 1, len(names)]  # the level before the target
    products = sums[np.ix_(order, order)]
    # prior scales are shares of the series' size; a log is a share already
    size = 1.0 if multiplicative else math.sqrt(products[-1, -1] / n) or 1.0
    kinds = {"t": SLOPE_SCALE, **{f"t_{i}": CHANGE_SCALE for i in range(1, CHANGEPOINTS + 1)}}
    scales = np.array([*(kinds.get(c, SEASON_SCALE) for c in names), np.inf]) * size
    change = np.array([*(c.startswith("t_") for c in names), False])
    beta, covariance, noise = solve(products, n, change, scales)
    return Baseline(names, beta, covariance, noise, start, end, multiplicative, yearly)
