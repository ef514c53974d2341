"""Guarded ratios and the text cells of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR_WIDTH = 50


def share_percent(part: Column, total: Column) -> Column:
    """``part / total * 100``, or 0 where there is no total."""
    return F.when(total > 0, F.try_divide(part.cast("double"), total) * 100).otherwise(F.lit(0.0))


def per_minute(count: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.try_divide(count.cast("double"), duration) * 60).otherwise(F.lit(0.0))


def title_case(text: Column) -> Column:
    """First letter upper, all others lower: 'phase shift' becomes 'Phase shift'."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def bar(percent: Column) -> Column:
    """One block for every two full percent."""
    return F.repeat(F.lit("█"), F.floor(percent / 2).cast("int"))


def padded_bar(percent: Column) -> Column:
    return F.rpad(bar(percent), BAR_WIDTH, "░")


def _scaled(value: Column, factor: int) -> Column:
    """``value * factor`` rounded to a whole number, halves to even, judged on the exact product.

    The product of two doubles is their rounded product plus a remainder that is itself a double;
    splitting the value into two short halves makes the remainder exact.
    """
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    product = value * F.lit(float(factor))
    remainder = (high * F.lit(float(factor)) - product) + (value - high) * F.lit(float(factor))
    below = F.floor(product)
    beyond_half = (product - below.cast("double") - F.lit(0.5)) + remainder
    up = (beyond_half > 0) | ((beyond_half == 0) & (below % 2 != 0))
    return below + up.cast("long")


def fixed(value: Column, decimals: int) -> Column:
    """Decimal text with a set number of places, as ``%.<n>f`` prints it."""
    factor = 10**decimals
    whole = _scaled(F.abs(value), factor)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.lpad((whole % factor).cast("string"), decimals, "0")
    return F.concat(sign, ((whole - whole % factor) / factor).cast("long").cast("string"), F.lit("."), digits)
