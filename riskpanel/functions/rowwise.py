"""Row-wise expressions across columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the non-null values in a row; NULL when all are NULL."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(total, n.cast("double"))


def row_argmax(cols: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """Name of the column holding the row maximum; the first wins ties,
    NULLs are skipped and an all-NULL row gives NULL."""
    names = list(names or cols)
    m = F.greatest(*[F.col(c) for c in cols])
    expr = F.when(F.col(cols[0]) == m, F.lit(names[0]))
    for c, n in zip(cols[1:], names[1:]):
        expr = expr.when(F.col(c) == m, F.lit(n))
    return expr
