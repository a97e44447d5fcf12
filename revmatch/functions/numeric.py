"""Scalar number expressions. All stay JVM-side inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rating range, and the factor from a rating to the reference scale.
RATING_MIN, RATING_MAX = -2, 2
AFFINITY_PER_RATING = 10

_NUMBER = r"(?i)^[+-]?((\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)(e[+-]?\d(_?\d)*)?|inf|infinity|nan)$"


def round9(x: Column) -> Column:
    """Nine decimals, halves up. ``floor`` keeps it in codegen; ``round`` would go through BigDecimal."""
    return F.floor(x * 1e9 + F.lit(0.5)) / F.lit(1e9)


def round_half_away(x: Column) -> Column:
    y = round9(x)
    return (F.signum(y) * F.floor(F.abs(y) + F.lit(0.5))).cast("int")


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def signed_power(x: Column, exponent: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(exponent)))


def parse_rating(raw: Column) -> Column:
    """Rating text to an int in [-2, 2]; blank, NaN and non-numbers give 0."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$", "")
    number = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    known = F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))
    return round_half_even(clamp(known, float(RATING_MIN), float(RATING_MAX))).cast("int")


def affinity(rating: Column) -> Column:
    return rating * F.lit(AFFINITY_PER_RATING)


def shortlist_size(n: Column, positive_frac: float, floor: int, cushion: int) -> Column:
    """Automatic shortlist length, in double arithmetic from left to right."""
    band = F.lit(float(cushion) * positive_frac) * n.cast("double")
    return F.greatest(F.lit(floor).cast("bigint"), F.ceil(band))
