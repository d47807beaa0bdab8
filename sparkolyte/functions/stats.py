"""Column expressions shared by the operators. ANSI mode stays on, so divisions go through try_divide."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN and infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def pearson(x: Column, y: Column, least: int = 2) -> Column:
    """Correlation from moments; NULL for a constant side or fewer than least pairs."""
    x, y = (F.when(x.isNotNull() & y.isNotNull(), c).cast("double") for c in (x, y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count(x) >= least) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), r)


def in_order(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Adds _sum, the running sum of value within keys by order; ordered_mean takes the last one.

    A sum of doubles depends on its order in the last digits, which decides between equal means and at thresholds.
    """
    here = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("_sum", F.sum(value).over(here))


def ordered_mean(value: str, order: str) -> Column:
    """The mean of value by a sum in the given order, over rows of in_order(...); NULL without values."""
    return F.try_divide(F.max_by("_sum", order), F.count(value))


def centred(df: DataFrame, keys: list[str], w: Column, **columns: Column) -> DataFrame:
    """Adds for each name _m_<name>, the column's weighted mean within keys, and _c_<name>, its distance from it.

    Sums of such distances lose no digits to the means, however far apart the weights are.
    """
    here = W.partitionBy(*keys)
    means = {f"_m_{n}": F.try_divide(F.sum(w * c).over(here), F.sum(w).over(here)) for n, c in columns.items()}
    return df.withColumns(means).withColumns({f"_c_{n}": c - F.col(f"_m_{n}") for n, c in columns.items()})


def weighted_line(w: Column) -> tuple[Column, Column]:
    """Slope and intercept of weighted least squares of y on x, over rows of centred(..., x=, y=)."""
    x, y = F.col("_c_x"), F.col("_c_y")
    slope = F.try_divide(F.sum(w * x * y), F.sum(w * x * x))
    return slope, F.max("_m_y") - slope * F.max("_m_x")


def parabola(w: Column) -> Column:
    """The quadratic coefficient of weighted least squares, over rows of centred(..., x=, y=).

    x and y are centred, so the normal equations are two: those of the slope and of the square less its projections.
    """
    x, y = F.col("_c_x"), F.col("_c_y")
    s0, s2, s3, s4 = F.sum(w), F.sum(w * x * x), F.sum(w * x * x * x), F.sum(w * x * x * x * x)
    t1, t2 = F.sum(w * x * y), F.sum(w * x * x * y)
    return F.try_divide(t2 - F.try_divide(s3 * t1, s2), s4 - F.try_divide(s3 * s3, s2) - F.try_divide(s2 * s2, s0))


def _hat(window: int, poly: int) -> np.ndarray:
    """Row k gives the value at place k of a least-squares polynomial through a window's values."""
    basis = np.vander(np.arange(window) - window // 2, min(poly, window - 1) + 1, increasing=True).astype(float)
    return basis @ np.linalg.pinv(basis)


def savgol(values: Column, window: int, poly: int, least: int = 3) -> Column:
    """Least-squares polynomial smoothing of an array; its ends take the polynomials of the first and last window.

    The window is made odd downwards and no longer than the array; below `least` values the array stays as it is.
    """
    widths = [n for n in range(3, window + 1, 2) if n >= least]
    if not widths:
        return values

    def smooth(y: Column) -> Column:
        out = F.when(F.size(y) < widths[0], y)
        for width in widths:
            rows = F.array(*[F.array(*[F.lit(float(h)) for h in row]) for row in _hat(width, poly)])

            fits = F.size(y) >= width if width == widths[-1] else F.size(y) < width + 2
            out = out.when(fits, F.transform(y, _place(y, width, rows)))
        return out

    return bind(values, smooth)


def _place(y: Column, width: int, rows: Column):
    """The smoothed value at place i of y."""

    def value(_: Column, i: Column) -> Column:
        start = F.least(F.greatest(i - width // 2, F.lit(0)), F.size(y) - width)
        parts = F.zip_with(F.get(rows, i - start), F.slice(y, start + 1, F.lit(width)), lambda h, x: h * x)
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    return value


def median(c: Column) -> Column:
    return F.median(c)


def bind(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
