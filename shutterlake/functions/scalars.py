"""Text, number and date helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def round_half_up(value: Column, scale: float = 1) -> Column:
    """Rounds .5 towards positive infinity (also below zero), to multiples of 1/scale."""
    rounded = F.floor(value * F.lit(float(scale)) + F.lit(0.5)).cast("double")
    return rounded if scale == 1 else rounded / F.lit(float(scale))


def contains_ignore_case(value: Column, needle: str) -> Column:
    """Substring match; ``%`` and ``_`` in the needle stay wildcards."""
    return value.ilike(f"%{needle}%")


def normal_word(value: Column) -> Column:
    return F.lower(F.trim(value))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def date_stem(value: Column) -> Column:
    """``2024-06-15T14:30:00.123Z`` -> ``20240615_143000``."""
    compact = F.regexp_replace(value, "[-:]", "")
    compact = F.regexp_replace(compact, "^([^T]*)T", "$1_")
    return F.substring(F.regexp_replace(compact, r"\.\d+.*$", ""), 1, 15)


def clock(hour: Column, minute: Column) -> Column:
    """``HH:MM``."""
    return F.concat(
        F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")
    )


def js_number(value: Column) -> Column:
    """Prints whole doubles without a fraction, as JSON-style number text does."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def text_or_null(value: Column) -> Column:
    """Trims; only text that was empty before trimming counts as missing."""
    return F.when(F.length(value) > 0, F.trim(value))


def finite_number(value: Column) -> Column:
    """Text or number -> finite double, else null."""
    number = value.try_cast("double")
    broken = F.isnan(number) | number.isin(float("inf"), float("-inf"))
    return F.when(~broken, number)
