"""Arithmetic in which an absent value stays absent and never turns into zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Text to double; empty or malformed text is null (a plain cast raises under ANSI)."""
    return text.try_cast("double")


def to_count(text: Column) -> Column:
    """Text to integer; anything but a whole number is null."""
    return text.try_cast("bigint")


def micros_to_currency(micros: Column) -> Column:
    return micros.cast("double") / F.lit(1e6)


def null_add(a: Column, b: Column) -> Column:
    """Sum of two values where null means 'not reported'."""
    return F.coalesce(a + b, a, b)


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Null on a null or zero denominator, also for 0/0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(fraction: Column) -> Column:
    return fraction * F.lit(100.0)


def finite(value: Column) -> Column:
    """NaN and the infinities become null. Spark orders NaN above every number."""
    v = value.cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def half_even(value: Column, places: int = 0) -> Column:
    """Round half to even on the double itself.

    `rint` stays inside code generation; `bround` goes through BigDecimal for every row. Adding
    0.0 turns a negative zero into zero.
    """
    scale = F.lit(float(10**places))
    v = value.cast("double")
    if places == 0:
        return F.rint(v) + F.lit(0.0)
    return F.rint(v * scale) / scale + F.lit(0.0)


def rnd(value: Column, places: int = 2) -> Column:
    return half_even(finite(value), places)


def rnd_sql(value: str, places: int = 2) -> str:
    """`rnd` as SQL text, for figures that are finite or null already."""
    return f"(rint({value} * {float(10 ** places)}D) / {float(10 ** places)}D + 0.0D)"


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weighted average over rows that carry both a value and a non-zero weight."""
    usable = value.isNotNull() & weight.isNotNull() & (weight != 0)
    return safe_div(F.sum(F.when(usable, value * weight)), F.sum(F.when(usable, weight)))


def weight_used(value: Column, weight: Column) -> Column:
    """Aggregate: the weight that `weighted_mean` rests on; 0 when nothing contributed."""
    usable = value.isNotNull() & weight.isNotNull() & (weight != 0)
    return F.coalesce(F.sum(F.when(usable, weight)).cast("double"), F.lit(0.0))


def label_or(text: Column, default: str) -> Column:
    """A null or empty label takes the default."""
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)
