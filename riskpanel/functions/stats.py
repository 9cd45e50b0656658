"""Statistical expressions: null-safe correlation and chi-square tail probability."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; NULL (not an ANSI error) for a constant side."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_sparse(n: Column, mean_y: Column, ss_y: Column, n1: Column, mean_x1: Column, ss_x1: Column,
                mean_y1: Column, co_1: Column) -> Column:
    """Pearson correlation from centred moments of the rows that hold a value (``1``: count, mean and
    sum of squares of x, mean of y, co-moment) and of y over all ``n`` rows, x being 0 in the
    others. Centred sums keep a small variance beside a large mean; a constant side gives NULL.
    """
    ss_x = ss_x1 + n1 * (n - n1) / n * mean_x1 * mean_x1
    co = co_1 + mean_x1 * n1 * (mean_y1 - mean_y)
    return F.when((ss_x > 0) & (ss_y > 0), co / (F.sqrt(ss_x) * F.sqrt(ss_y)))


def corr_support(n: Column, n_a: Column, at_a: Column, own_a: Column, sq_a: Column, n_b: Column, at_b: Column, own_b: Column,
                 sq_b: Column, n_ab: Column, sum_a: Column, sum_b: Column, sum_ab: Column) -> Column:
    """Pearson correlation of two sparse columns over ``n`` rows, from sums of values less a constant near their mean.

    a has ``n_a`` values of its own, ``own_a`` and ``sq_a`` are sum and sum of squares of them less ``at_a`` (b likewise); over the ``n_ab``
    rows that hold both, ``sum_a``, ``sum_b`` and ``sum_ab`` are those of the two and of their product. Nothing large is
    subtracted from anything large, so a small spread beside a large mean is kept; a constant side gives NULL.
    """
    def spread(n_x: Column, at: Column, own: Column, sq: Column) -> Column:
        return sq - own * own / n + (n - n_x) / n * (2 * at * own + at * at * n_x)

    var_a, var_b = spread(n_a, at_a, own_a, sq_a), spread(n_b, at_b, own_b, sq_b)
    co = sum_ab - own_a * own_b / n + at_b * (sum_a - own_a * n_b / n) + at_a * (sum_b - own_b * n_a / n) + at_a * at_b * (n_ab - n_a * n_b / n)
    return F.when((var_a > 0) & (var_b > 0), co / (F.sqrt(var_a) * F.sqrt(var_b)))


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(100_000 + int(20 * math.sqrt(a))):
            ap += 1
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-16:
                break
        else:
            raise ArithmeticError(f"gamma series did not converge for a={a}, x={x}")
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - lg))
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 100_000 + int(20 * math.sqrt(a))):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"gamma fraction did not converge for a={a}, x={x}")
    return math.exp(-x + a * math.log(x) - lg) * h


def chi2_sf_value(stat: float, dof: int) -> float:
    if stat is None or dof is None or (isinstance(stat, float) and math.isnan(stat)) or dof <= 0:
        return float("nan")
    if dof == 1:
        return math.erfc(math.sqrt(stat / 2.0))
    return _gammaincc(dof / 2.0, stat / 2.0)


@pandas_udf(DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution (the test's p-value), Arrow-batched."""
    return pd.Series([chi2_sf_value(float(s), int(d)) if pd.notna(s) and pd.notna(d) else np.nan
                      for s, d in zip(stat, dof)], dtype="float64")
