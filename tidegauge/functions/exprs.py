"""Null-safe column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: Column | float | None, high: Column | float | None) -> Column:
    """``c`` held within the bounds that are not null; null stays null."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def finite(c: Column | str) -> Column:
    """``c`` as a double, null where it is no finite number."""
    number = col(c).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def slope(y: Column | str, x: Column | str, over: WindowSpec | None = None) -> Column:
    """Least-squares slope; null with fewer than two points or no spread in ``x``."""
    value = F.regr_slope(col(y), col(x))
    return value.over(over) if over is not None else value


def safe_corr(a: Column | str, b: Column | str, floor: float = 1e-9) -> Column:
    """Pearson correlation, null where either side is constant (plain ``corr`` raises under ANSI)."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.stddev_pop(a) > floor) & (F.stddev_pop(b) > floor), F.try_divide(F.covar_pop(a, b), spread))


def rounded(df, columns: Sequence[str], digits: int = 6):
    """``df`` with the named columns rounded, minus zero written as zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by its rational Chebyshev fit (relative error under 1.2e-7)."""
    t = 1.0 / (1.0 + 0.5 * x)
    # The fit's coefficients, constant term first.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)
