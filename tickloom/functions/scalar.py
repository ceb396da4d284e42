"""Scalar building blocks. Missing is NULL throughout; a zero denominator gives NULL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_FROM = date(2025, 1, 1)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def micros(moment: Column) -> Column:
    """Microseconds since the epoch of a time without zone."""
    return F.unix_micros(moment.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def epoch_to_time(epoch: Column, day: Column | None = None) -> Column:
    """Milliseconds; microseconds for files of days from MICROS_FROM on, if day is given."""
    millis = F.timestamp_millis(epoch)
    if day is None:
        return millis.cast("timestamp_ntz")
    return F.when(day < F.lit(MICROS_FROM), millis).otherwise(F.timestamp_micros(epoch)).cast("timestamp_ntz")


def maker_sign(is_buyer_maker: Column) -> Column:
    """-1 when the buyer is the maker, so the taker sells."""
    return F.lit(1) - 2 * is_buyer_maker.cast("int")


def side_sign(side: Column) -> Column:
    """-1 for SELL; 1 for all else, null and other spellings included."""
    return F.when(side == "SELL", -1).otherwise(1)


def grid_round(value: Column, digits: int) -> Column:
    """Rounds half up by floor, which every engine does alike."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def keep_finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def bps(new: Column, old: Column) -> Column:
    """Relative change in basis points."""
    return (safe_div(new, old) - 1) * 1e4
