"""Numbers: lenient coercion, clamps, counter-based random draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number from text, null for anything else; NaN counts as null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def first_number(text: Column) -> Column:
    """The first number in a text."""
    return F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def uniform(*parts: Column, at: int = 1) -> Column:
    """A number in (0, 1) from eight digits of the MD5 of the parts: the same on any engine and partitioning."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def gauss(*parts: Column) -> Column:
    """A standard normal draw by Box-Muller from two uniform ones, of the same MD5."""
    return F.sqrt(-2.0 * F.ln(uniform(*parts))) * F.cos(uniform(*parts, at=9) * (2.0 * math.pi))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a rational approximation (error below 7.5e-8)."""
    t = 1.0 / (1.0 + F.abs(x) * 0.2316419)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)
