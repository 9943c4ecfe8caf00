"""Small expression helpers shared by the jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    """Mean of a short array; added up in sorted order, so that equal contents give equal results."""
    return F.try_divide(array_sum(F.array_sort(values)), F.size(values).cast("double"))


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x * x)))


def letter(index: Column) -> Column:
    """0 → A, 1 → B, …"""
    return F.char(F.lit(65) + index)


def letters(n: Column) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), letter)).otherwise(
        F.array().cast("array<string>")
    )


def three_places(value: Column) -> Column:
    """Text with three decimals, rounded as C's ``%.3f``: by the exact binary value, ties to even.

    The value is split into two halves whose products with 1000 are exact, so
    the comparison with the midpoint is exact too.
    """
    x = F.abs(value.cast("double"))

    def of(s: Column) -> Column:
        mid = s["k"].cast("double") + 0.5
        side = (s["high"] * 1000 - mid) + (s["x"] - s["high"]) * 1000
        n = s["k"] + F.when((side > 0) | ((side == 0) & (s["k"] % 2 == 1)), 1).otherwise(0)
        return F.concat(
            F.floor(n / 1000).cast("long").cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0")
        )

    shifted = x * F.lit(134217729.0)  # 2^27 + 1
    parts = F.struct(x.alias("x"), (shifted - (shifted - x)).alias("high"), F.floor(x * 1000).cast("long").alias("k"))
    return F.concat(F.when(value < 0, "-").otherwise(""), let(parts, of))
