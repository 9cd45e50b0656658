"""Model evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.stats import safe_corr


def linspace_edges(start: float = 0.0, stop: float = 2.0, num: int = 300) -> list[float]:
    """Threshold grid: ``num`` evenly spaced values, both ends included."""
    return [float(x) for x in np.linspace(start, stop, num)]


def _is_linspace(edges: Sequence[float]) -> bool:
    n = len(edges)
    return n >= 2 and list(edges) == linspace_edges(edges[0], edges[-1], n)


def bucket_index(col: Column | str, edges: Sequence[float]) -> Column:
    """Number of edges ``<= x`` (so ``x < edges[i]`` exactly when the result ``<= i``).

    Evenly spaced edges use an O(1) estimate ``floor((x - e0) / step)`` corrected
    by one comparison against the exact edge values on each side; other sorted
    edges count matches with a higher-order ``filter``. NULL stays NULL; NaN
    and values above the last edge get ``len(edges)``.
    """
    x = F.col(col) if isinstance(col, str) else col
    x = x.cast("double")
    n = len(edges)
    arr = F.array(*[F.lit(float(e)) for e in edges])
    if not _is_linspace(edges):
        return F.size(F.filter(arr, lambda e: e <= x)).cast("int")
    e0, step = float(edges[0]), (float(edges[-1]) - float(edges[0])) / (n - 1)
    k = F.floor((x - F.lit(e0)) / F.lit(step)).cast("int")   # estimate of last edge index <= x
    k = F.least(F.greatest(k, F.lit(-1)), F.lit(n - 1))
    nxt = F.element_at(arr, k + 2)       # edges[k + 1] (1-based element_at)
    cur = F.element_at(arr, F.greatest(k, F.lit(0)) + 1)
    est = (F.when((k + 1 <= n - 1) & (nxt <= x), k + 2)
            .when((k >= 0) & (cur > x), k)
            .otherwise(k + 1))
    return (F.when(x.isNull(), F.lit(None).cast("int"))
             .when(F.isnan(x) | (x >= F.lit(float(edges[-1]))), F.lit(n))
             .when(x < F.lit(float(edges[0])), F.lit(0))
             .otherwise(est).cast("int"))


def threshold_curve(df: DataFrame, scores: Sequence[str], measure: str,
                    edges: Sequence[float] | None = None) -> DataFrame:
    """For every threshold ``t_i``, the rows with ``score < t_i``:
    ``accepted`` count, ``accept_pct`` of all rows, ``mean_measure`` of ``measure``
    over the accepted rows (NULL when none), for each score column.

    Not an N x 300 theta join: each row gets the index of its first threshold
    above it, rows are counted per (score, index) with a partial aggregate
    (at most ``len(edges) + 1`` groups per score), and the curve is a cumulative
    window over that tiny table.
    """
    edges = list(edges) if edges is not None else linspace_edges()
    n = len(edges)
    long = df.select(F.col(measure).cast("double").alias("__m"),
                     F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"),
                                                  F.col(s).cast("double").alias("__s"))
                                         for s in scores])).alias("__p"))
    # buckets 0..n-1 can be accepted; n = at or above the last edge (or NaN);
    # n + 1 = NULL score: never accepted, still counted in the total
    b = F.coalesce(bucket_index("__p.__s", edges), F.lit(n + 1))
    long = long.select("__p.score_name", b.alias("i"), "__m")
    counts = long.groupBy("score_name", "i").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__m").alias("__sm"), F.count("__m").alias("__nm"))
    # every (score, bucket) index as a literal (scores x (n + 2) rows, set by the
    # parameters): the count table has a single consumer, so the input is read once
    idx = df.sparkSession.createDataFrame([(s, i) for s in scores for i in range(n + 2)], "score_name string, i int")
    per_i = idx.join(counts, ["score_name", "i"], "left")
    whole = Window.partitionBy("score_name")
    w = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.col("__n"), F.lit(0))).over(whole)
    cum_n = F.sum(F.coalesce(F.col("__n"), F.lit(0))).over(w)
    cum_sm = F.sum(F.coalesce(F.col("__sm"), F.lit(0.0))).over(w)
    cum_nm = F.sum(F.coalesce(F.col("__nm"), F.lit(0))).over(w)
    arr = F.array(*[F.lit(float(e)) for e in edges])
    curve = per_i.select(
        "score_name", F.col("i").cast("int").alias("i"),
        F.try_element_at(arr, F.col("i") + 1).alias("threshold"),  # NULL for the two extra buckets
        cum_n.cast("long").alias("accepted"),
        (F.try_divide(cum_n, total) * 100.0).alias("accept_pct"),
        F.try_divide(cum_sm, cum_nm.cast("double")).alias("mean_measure"))
    return curve.where(F.col("i") < n)


def regression_metrics(df: DataFrame, truth: str, preds: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """R², MSE, RMSE and mean error (prediction - truth) per prediction, one pass."""
    parts = []
    for p in preds:
        e = F.col(p).cast("double") - F.col(truth).cast("double")
        parts.append(F.struct(F.lit(p).alias("model"), e.alias("err"),
                              F.col(truth).cast("double").alias("y")))
    long = df.select(*by, F.explode(F.array(*parts)).alias("__r")).select(*by, "__r.*")
    long = long.where(F.col("err").isNotNull())
    g = long.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("err") * F.col("err")).alias("mse"),
        F.avg("err").alias("mean_error"), F.var_pop("y").alias("__vy"))
    return g.select(*by, "model", "n", "mse", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("__vy"))).alias("r2"),
                    "mean_error")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """T5: Pearson correlation of every pair of score columns in one aggregate pass
    (long output ``(col_a, col_b, corr)``; constant columns give NULL)."""
    aggs = [safe_corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    row = df.agg(*aggs)
    pairs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}_{j}").alias("corr"))
             for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def band_report(df: DataFrame, band_col: str, measures: Sequence[str] | None = None) -> DataFrame:
    """A4: band size and the mean of every numeric measure per band."""
    if measures is None:
        numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
        measures = [c for c, t in df.dtypes if t in numeric or t.startswith("decimal")]
    return df.groupBy(band_col).agg(F.count(F.lit(1)).alias("n"),
                                    *[F.avg(m).alias(f"mean_{m}") for m in measures])


def mean_comparison(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Overall mean of truth and of each model's prediction, long form."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols])
    return row.unpivot([], list(cols), "series", "mean")


def join_scores(scores: DataFrame, legacy: DataFrame, key: str, legacy_key: str) -> DataFrame:
    """Inner join on differently named keys; both keys kept."""
    return scores.join(legacy, scores[key] == legacy[legacy_key], "inner")
