"""Feed cleaners: types, codes, duplicates, bounds. One function per feed."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import parse_date, parse_date_strict
from ..functions.codes import trust_code
from ..functions.numbers import half_even_long, nan_to_null
from ..operators.cleaning import (
    clip_columns, clip_to_quantiles, drop_null_keys, impute_median, lower_headers, rename,
)
from ..operators.dedup import keep_first
from ..operators.quantiles import exact_quantiles
from ..sources.layers import store

log = logging.getLogger(__name__)

# Ingest order: which of several rows with one key came first. Readers add it (sources.scans).
ORDER = "ingest_order"

ACTIVITY_COUNTS = ("admissions", "discharges", "bed_occupancy_count", "ae_attendances", "referrals")
# Plausible ranges of the feeds.
WAITING_BOUNDS = {"waiting_list_size": (0, 200_000), "median_wait_days": (0, 365)}
WORKFORCE_BOUNDS = {"vacancy_rate": (0, 50)}
ILLNESS_BOUNDS = {"flu_index": (0, 50), "covid_index": (0, 50)}
WEATHER_BOUNDS = {"avg_temp_c": (-15, 40)}


def _base(df: DataFrame) -> DataFrame:
    return nan_to_null(lower_headers(df))


def _first(df: DataFrame, *keys: str) -> DataFrame:
    return keep_first(df, list(keys), [ORDER]).drop(ORDER)


@dataclass(frozen=True)
class Profile:
    """Figures of whole feeds that cleaning needs, kept so that every load of a part uses the same."""

    activity: dict[str, tuple[float, float]]
    median_wait_days: float | None


def _distinct_waiting(df: DataFrame) -> DataFrame:
    df = _base(df).withColumn("trust_code", trust_code(F.col("trust_code")))
    df = _first(drop_null_keys(df, "trust_code"), "trust_code", "specialty", "period")
    return clip_columns(df, WAITING_BOUNDS)


def clean_waiting_list(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    df = _distinct_waiting(df)
    if profile is None:  # two readers follow (the median, then the result), so the de-duplicated rows are stored
        df = impute_median(store(df, "waiting_list_dedup"), "median_wait_days")
    elif "median_wait_days" in df.columns:
        df = df.withColumn("median_wait_days", F.coalesce("median_wait_days", F.lit(profile.median_wait_days)))
    return rename(df, {"specialty": "specialty_id"})


def _distinct_activity(df: DataFrame) -> DataFrame:
    df = _base(df).withColumns(
        {"trust_code": trust_code(F.col("trust_code")), "date": parse_date(F.col("date"))}
    )
    return _first(drop_null_keys(df, "date", "trust_code"), "trust_code", "specialty", "date")


def clean_activity(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    df = _distinct_activity(df)
    counts = [c for c in ACTIVITY_COUNTS if c in df.columns]
    if profile is None:  # read by the quantiles and by the result
        df = clip_to_quantiles(store(df, "activity_dedup"), counts, lo=0)
    else:
        df = clip_columns(df, profile.activity)
    df = df.withColumns({c: half_even_long(F.col(c)) for c in counts})
    return rename(df, {"specialty": "specialty_id"})


def profile(feeds: dict[str, DataFrame]) -> Profile:
    """The clip bounds of the activity and the median wait, over whole feeds."""
    activity = _distinct_activity(feeds["activity"])
    counts = [c for c in ACTIVITY_COUNTS if c in activity.columns]
    high = exact_quantiles(store(activity.select(*counts), "activity_counts"), {c: [0.999] for c in counts})
    median = None
    if "waiting_list" in feeds:
        waits = _distinct_waiting(feeds["waiting_list"])
        if "median_wait_days" in waits.columns:
            waits = store(waits.select("median_wait_days"), "waits")
            median = exact_quantiles(waits, {"median_wait_days": [0.5]})["median_wait_days"][0.5]
    return Profile({c: (0, high[c][0.999]) for c in counts}, median)


def clean_workforce(df: DataFrame) -> DataFrame:
    df = _base(df).withColumn("trust_code", trust_code(F.col("trust_code")))
    return clip_columns(_first(df, "trust_code", "role"), WORKFORCE_BOUNDS)


def clean_illness(df: DataFrame) -> DataFrame:
    df = _base(df).withColumn("date", parse_date(F.col("date")))
    return clip_columns(_first(drop_null_keys(df, "date"), "date"), ILLNESS_BOUNDS)


def clean_weather(df: DataFrame) -> DataFrame:
    df = _base(df).withColumn("date", parse_date(F.col("date")))
    df = _first(drop_null_keys(df, "date", "region_id"), "date", "region_id")
    return clip_columns(df, WEATHER_BOUNDS)


def clean_demographics(df: DataFrame) -> DataFrame:
    return _first(_base(df), "region_id")


def clean_dim_date(df: DataFrame) -> DataFrame:
    return _first(df.withColumn("date_key", parse_date_strict(F.col("date_key"))), "date_key")


def clean_dim_hospital(df: DataFrame) -> DataFrame:
    return _first(
        df.withColumn("hospital_id", F.trim(F.col("hospital_id").cast("string"))), "hospital_id"
    )


def clean_dim_specialty(df: DataFrame) -> DataFrame:
    return _first(df, "specialty_id")


def clean_dim_region(df: DataFrame) -> DataFrame:
    return _first(df, "region_id")


CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "waiting_list": clean_waiting_list,
    "activity": clean_activity,
    "workforce": clean_workforce,
    "illness": clean_illness,
    "weather": clean_weather,
    "demographics": clean_demographics,
    "dim_date": clean_dim_date,
    "dim_hospital": clean_dim_hospital,
    "dim_specialty": clean_dim_specialty,
    "dim_region": clean_dim_region,
}


def within(feeds: dict[str, DataFrame], start: dt.date, end: dt.date) -> dict[str, DataFrame]:
    """The rows of dated feeds from start to end, and waiting periods from start's month to end's.

    Dates are read as the cleaners read them; rows without a readable date can't be kept by them.
    """
    out = dict(feeds)
    for name, df in feeds.items():
        named = {c.strip().lower(): c for c in df.columns}
        if name in ("activity", "illness", "weather") and "date" in named:
            out[name] = df.filter(parse_date(F.col(f"`{named['date']}`")).between(F.lit(start), F.lit(end)))
        elif name == "waiting_list" and "period" in named:
            month = F.substring(F.col(f"`{named['period']}`").cast("string"), 1, 7)
            out[name] = df.filter(month.between(f"{start:%Y-%m}", f"{end:%Y-%m}"))
    return out


def clean_all(feeds: dict[str, DataFrame], profile: Profile | None = None) -> dict[str, DataFrame]:
    """Clean every known feed; unknown names are skipped with a warning.

    With a profile, the figures of the whole feeds are taken from it instead of from these rows.
    """
    cleaned = {}
    for name, df in feeds.items():
        cleaner = CLEANERS.get(name)
        if cleaner is None:
            log.warning("no cleaner for feed %s", name)
        elif cleaner in (clean_activity, clean_waiting_list):
            cleaned[name] = cleaner(df, profile)
        else:
            cleaned[name] = cleaner(df)
    return cleaned
