"""Cleaning steps shared by the feed cleaners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import clip
from .quantiles import exact_quantiles


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Fixed bounds; the columns become double and NULL stays NULL."""
    return df.withColumns(
        {c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns}
    )


def clip_to_quantiles(
    df: DataFrame,
    columns: list[str],
    lo: float | None = None,
    low_probability: float = 0.001,
    high_probability: float = 0.999,
) -> DataFrame:
    """Clip to exact quantiles of the column; a given `lo` replaces the lower quantile."""
    columns = [c for c in columns if c in df.columns]
    probs = [high_probability] if lo is not None else [low_probability, high_probability]
    found = exact_quantiles(df, {c: probs for c in columns})
    bounds = {
        c: (lo if lo is not None else found[c][low_probability], found[c][high_probability])
        for c in columns
    }
    return clip_columns(df, bounds)


def impute_median(df: DataFrame, col: str) -> DataFrame:
    """Fill NULLs with the column median; no-op when the column is absent."""
    if col not in df.columns:
        return df
    median = exact_quantiles(df, {col: [0.5]})[col][0.5]
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(median)))


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a target schema by name, in its order and types; absent ones become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add columns the input does not carry."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def json_records(df: DataFrame) -> DataFrame:
    """One JSON document per row: NaN and NULL as null, dates and times in ISO form."""
    def safe(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(c), None).otherwise(c)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c

    fields = [safe(f).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
