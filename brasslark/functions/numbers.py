"""Number helpers as Column expressions. Unknown is NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b; NULL if either is NULL or b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change_pct(new: Column, old: Column) -> Column:
    """Change in percent of the size of the old value."""
    return divide((new - old) * 100.0, F.abs(old))


def cagr_pct(first: Column, last: Column, years: Column) -> Column:
    """Yearly growth in percent; NULL unless both ends and the span are positive."""
    return F.when((first > 0) & (last > 0) & (years > 0), (F.pow(divide(last, first), divide(F.lit(1.0), years)) - 1.0) * 100.0)


def scale(value: Column, worst: float, best: float) -> Column:
    """0 at worst, 100 at best, straight between, held at the ends; worst may be the larger. NULL stays NULL."""
    if best == worst:
        return F.when(value.isNotNull(), 50.0)
    return held((value - F.lit(float(worst))) / F.lit(float(best - worst)) * 100.0, 0.0, 100.0)


def held(value: Column, low: float, high: float) -> Column:
    """The value within its limits; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL if either has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def product(values: Column) -> Column:
    """Product of an array; NULL if any element is NULL."""
    return F.aggregate(values, F.lit(1.0), lambda s, x: s * x)


def grouped(value: Column, decimals: int = 0, group: str = ".", point: str = ",") -> Column:
    """A number as text with group and decimal signs of a locale."""
    return F.translate(F.format_number(value, decimals), ",.", f"{group}{point}")
