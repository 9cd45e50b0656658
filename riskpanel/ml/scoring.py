"""Batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.text import normalise_name


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Normalise names (``.0`` -> ``_0``), add the model's missing features as 0,
    drop extras and order as the model expects; one projection."""
    have = {normalise_name(c): c for c in df.columns}
    cols = [F.col(f"`{c}`") for c in keep]
    for f in features:
        src = have.get(normalise_name(f))
        cols.append(F.coalesce(F.col(f"`{src}`").cast("double"), F.lit(0.0)).alias(f) if src
                    else F.lit(0.0).alias(f))
    return df.select(*cols)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], prediction: str = "prediction",
          out: str = "y_pred") -> DataFrame:
    """Attach predictions to their rows (row identity kept by the
    narrow transform; no positional re-alignment)."""
    return model.transform(df).select(*keep, F.col(prediction).alias(out))
