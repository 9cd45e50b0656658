"""Target encoding by band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.binning import band8


def encode_by_mean(df: DataFrame, key: str, target: str, fit_folds: Sequence[int] | None = None,
                   fold: str = "fold", banding=band8, out: str = "category") -> DataFrame:
    """Map of key -> band of the key's mean target: ``(key, mean, category)``.

    ``fit_folds`` restricts the means to training folds (the reference fits on
    every file, test included, which leaks; pass the training folds to avoid it).
    """
    src = df.where(F.col(fold).isin(list(fit_folds))) if fit_folds is not None else df
    means = src.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(target).alias("mean"))
    return means.select(key, "mean", banding(F.col("mean")).alias(out))
