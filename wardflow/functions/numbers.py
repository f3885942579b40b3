"""Numeric helpers with explicit NULL, NaN and zero handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_if_nan(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (NaN sorts above all numbers in Spark)."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in floats}) if floats else df


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Bound a value. NULL stays NULL, which least()/greatest() would not guarantee."""
    out = c
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: how array libraries round doubles."""
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def round_scaled(c: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back: how SQL engines round doubles."""
    scale = F.lit(10.0**digits)
    return F.round(c.cast("double") * scale, 0) / scale


def _exact_units(c: Column, digits: int, ties_up: bool) -> Column:
    """abs(c) in units of 10**-digits as a long, rounded by the exact binary value.

    The fraction is scaled by a power of two, which is exact for values from 1/16 up, and compared
    with one half in integer arithmetic.
    """
    bits = 63 - (10**digits).bit_length()
    x = F.abs(c.cast("double"))
    fraction = x - F.floor(x)
    scaled = (fraction * F.lit(float(2**bits))).cast("long") * F.lit(10**digits)
    whole = F.shiftright(scaled, bits)
    rest = scaled.bitwiseAND(F.lit(2**bits - 1))
    half = F.lit(2 ** (bits - 1))
    tie = F.lit(True) if ties_up else whole % 2 == 1
    up = F.when((rest > half) | ((rest == half) & tie), 1).otherwise(0)
    return F.floor(x).cast("long") * 10**digits + whole + up


def round_exact(c: Column, digits: int, ties_up: bool = False) -> Column:
    """Correctly rounded decimal of a double (9.35 is just below the tie, so 9.3); exact ties go to
    the even digit or up."""
    value = _exact_units(c, digits, ties_up) / F.lit(10.0**digits)
    return F.when(c < 0, F.lit(0.0) - value).otherwise(value)


def one_decimal(c: Column) -> Column:
    """Text with one decimal place of the correctly rounded value."""
    units = _exact_units(c, 1, False)
    sign = F.when((c < 0) & (units > 0), "-").otherwise("")
    return F.concat(sign, F.floor(units / 10).cast("string"), F.lit("."), (units % 10).cast("string"))


def no_decimal(c: Column) -> Column:
    return F.bround(c, 0).cast("long").cast("string")


def percent(a: Column, b: Column) -> Column:
    """a / b in percent, rounded to 2 places half to even, as decimal; NULL where b is zero."""
    share = F.try_divide(a.cast("double"), b.cast("double"))
    return round_even(share * 100.0, 2).cast("decimal(9,2)")


def mean(c: Column) -> Column:
    """Average as double. On decimals the sum is exact, so the result is order-independent."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def sum_or_zero(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def to_number(c: Column) -> Column:
    """Unparsable text becomes NULL instead of an error."""
    return c.try_cast("double")


def half_even_long(c: Column) -> Column:
    """NULL to 0, round half to even, cast to long."""
    return F.bround(F.coalesce(c.cast("double"), F.lit(0.0))).cast("long")


def scaled_band(yhat: Column, low: float, high: float) -> dict[str, Column]:
    """Forecast bounds as fixed multiples of the point forecast."""
    return {"yhat_lower": yhat * low, "yhat_upper": yhat * high}
