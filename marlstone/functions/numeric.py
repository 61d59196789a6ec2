"""Numbers: safe reading, clipping, rounding, time of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keeps denominators from zero.
EPS = 1e-9


def number(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """The column as a double; ``default`` where it is absent, null, NaN or no number."""
    if name not in df.columns:
        return F.lit(float(default))
    return F.coalesce(F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double")), F.lit(float(default)))


def not_nan(x: Column) -> Column:
    """Null where x is NaN, so rules and averages skip it."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def half_even(x: Column, digits: int = 4) -> Column:
    """x rounded half to even."""
    return F.bround(x, digits)


def minute_of_day(epoch_ms: Column, hours_east: int = 8) -> Column:
    """Minutes since midnight, fractions kept, at a fixed offset from UTC."""
    return F.pmod(epoch_ms / 1000 + hours_east * 3600, F.lit(86400)) / 60


def plain_date(x: Column) -> Column:
    """A date as YYYYMMDD text."""
    return F.substring(F.translate(x.cast("string"), "-", ""), 1, 8)
