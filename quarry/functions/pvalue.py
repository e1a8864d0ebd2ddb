"""Special functions for p-values, and their Spark forms. Only small result rows are passed through Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def igamc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: a series for small x, else a continued fraction (Lentz).

    For -1 < a <= 0 it is what the power series of the lower one leaves, by recurrence; not a number at x = 0, where that has no value.
    """
    if -1 < a <= 0:
        return igamc(a + 1, x) - math.exp(a * math.log(x) - x - math.lgamma(a + 1)) if x > 0 else math.nan
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, scale * h)


def erfc(x: Column) -> Column:
    """Complementary error function of a column; null stays null."""

    @F.pandas_udf(T.DoubleType())
    def run(values):
        return values.map(lambda v: None if v is None or v != v else math.erfc(v))

    return run(x.cast("double"))


def igamc_column(a: Column, x: Column) -> Column:
    """:func:`igamc` of two columns; null stays null."""

    @F.pandas_udf(T.DoubleType())
    def run(shapes, values):
        import pandas as pd

        return pd.Series([None if s is None or v is None or s != s or v != v else igamc(s, v) for s, v in zip(shapes, values, strict=True)], dtype="float64")

    return run(a.cast("double"), x.cast("double"))


def chi_square_p(statistic: Column, freedom: Column) -> Column:
    """Upper tail of the chi-squared distribution."""
    return igamc_column(freedom / 2, statistic / 2)
