"""Numeric expressions whose edge cases differ between pandas and ANSI Spark."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL instead of raising on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def corrected_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected sample skewness from the population value (NULL below three values)."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population value (NULL below four values)."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
