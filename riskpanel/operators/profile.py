"""Profiling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.binning import flag
from riskpanel.operators.evaluate import bucket_index, linspace_edges
from riskpanel.operators.quantiles import exact_quantiles
from riskpanel.session import materialize

def group_mean(df: DataFrame, by: Sequence[str] | str, measures: Sequence[str]) -> DataFrame:
    """A2: mean of each measure per group; NULL group keys are dropped (pandas groupby)."""
    by = [by] if isinstance(by, str) else list(by)
    keep = df
    for b in by:
        keep = keep.where(F.col(b).isNotNull())
    return keep.groupBy(*by).agg(*[F.avg(m).alias(m) for m in measures])


def by_dimension(df: DataFrame, dims: Sequence[str], target: str) -> DataFrame:
    """A3: for each dimension, per level: count of non-null target and its mean.

    One scan with GROUPING SETS ((d1), (d2), ...); output long
    ``(dimension, level, n, mean)``; NULL levels dropped.
    """
    gs = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    g = gs.agg(F.count(target).alias("n"), F.avg(target).alias("mean"),
               *[F.grouping(d).alias(f"__g_{i}") for i, d in enumerate(dims)])
    dim = None
    lvl = None
    for i, d in enumerate(dims):
        here = F.col(f"__g_{i}") == 0
        dim = F.when(here, F.lit(d)) if dim is None else dim.when(here, F.lit(d))
        lvl = F.when(here, F.col(d).cast("string")) if lvl is None else lvl.when(here, F.col(d).cast("string"))
    return g.select(dim.alias("dimension"), lvl.alias("level"), "n", "mean").where(F.col("level").isNotNull())


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A5: count, mean, sample std, min, 25/50/75 % (linear interpolation), max
    per column (and group); one row per (group, column).

    Moments come from one partial aggregate; quantiles from the distributed
    exact-rank selection (no value map in one task).
    """
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("__c")
    ).select(*by, "__c.column", "__c.v")
    long = long.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    for b in by:  # as everywhere, a NULL group key drops the row
        long = long.where(F.col(b).isNotNull())
    keys = [*by, "column"]
    mom = long.groupBy(*keys).agg(F.count("v").alias("count"), F.avg("v").alias("mean"),
                                  F.stddev_samp("v").alias("std"), F.min("v").alias("min"),
                                  F.max("v").alias("max"))
    q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], by=keys)
    return mom.join(q, keys, "left").select(*keys, "count", "mean", "std", "min",
                                            F.col("q25").alias("p25"), F.col("q50").alias("p50"),
                                            F.col("q75").alias("p75"), "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per value and its percentage of the non-null total (NULL excluded)."""
    # the count table is written once; its total is a literal, so a
    # high-cardinality column's counts stay spread over all partitions
    c = materialize(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count")), "value_counts")
    total = c.agg(F.sum("count")).first()[0]
    return c.select(column, "count", (F.try_divide(F.col("count"), F.lit(total)) * 100.0).alias("percentage"))


def prevalence(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A10: percent of rows whose value is non-zero, per column (and group).

    ``astype(bool)`` semantics: NULL counts as non-zero. One aggregate pass;
    the one-row-per-group result is unpivoted to ``(by..., column, pct_non_zero)``.
    """
    aggs = [(F.avg(F.when(F.col(c).isNull() | (F.col(c) != 0), 1).otherwise(0)) * 100.0).alias(c)
            for c in columns]
    row = df.groupBy(*by).agg(*aggs)
    return row.unpivot(list(by), list(columns), "column", "pct_non_zero")


def flag_means(df: DataFrame, column: str, op: str, threshold: float, measures: Sequence[str],
               flag_name: str = "flag") -> DataFrame:
    """Mean of several measures for flag = 1 / 0 (e.g. A/E >= 10)."""
    return (df.withColumn(flag_name, flag(column, op, threshold))
              .groupBy(flag_name).agg(*[F.avg(m).alias(m) for m in measures]))


def auto_bins(df: DataFrame, column: str) -> int:
    """The number of bins that the data ask for, the larger one of two rules.

    Widths are ``2 IQR / n^(1/3)`` (quartiles selected exactly), but at least half of ``range / sqrt(n)``, which bounds the bins by
    ``2 sqrt(n)`` however far outliers lie, and ``range / (log2(n) + 1)``. One bin for no values, a single value or equal ones.
    """
    v = F.col(column).cast("double")
    clean = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    r = clean.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not r.n or r.lo == r.hi:
        return 1
    q = exact_quantiles(clean, "v", [0.25, 0.75]).first()
    span = r.hi - r.lo
    spread = max(2.0 * (q.q75 - q.q25) / r.n ** (1.0 / 3.0), span / np.sqrt(r.n) / 2.0)
    return int(np.ceil(span / min(spread, span / (np.log2(r.n) + 1.0))))


def histogram(df: DataFrame, column: str, bins: int | str = 1000) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed), all bins listed; ``bins='auto'``: as many as
    :func:`auto_bins` says.

    The range is one small aggregate; bin edges follow ``linspace(min, max,
    bins + 1)`` and each value's bin is found arithmetically (no join).
    """
    bins = auto_bins(df, column) if bins == "auto" else bins
    v = F.col(column).cast("double")
    rng = df.where(v.isNotNull() & ~F.isnan(v)).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if rng.lo is None:  # no value: no bin
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    lo, hi = float(rng.lo), float(rng.hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    edges = linspace_edges(lo, hi, bins + 1)
    b = bucket_index(v, edges)
    counts = (df.where(v.isNotNull() & ~F.isnan(v))
                .select(F.least(b - 1, F.lit(bins - 1)).alias("bin"))
                .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    arr = F.array(*[F.lit(e) for e in edges])
    allbins = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (allbins.join(counts, "bin", "left")
                   .select("bin", F.element_at(arr, F.col("bin") + 1).alias("lo"),
                           F.element_at(arr, F.col("bin") + 2).alias("hi"),
                           F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def density(df: DataFrame, column: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an evenly spaced grid.

    n, std, min and max come from one aggregate; each value then adds its kernel to
    the grid points, exploded and summed by grid index with a partial aggregate (at
    most ``grid`` rows a task are shuffled). Output ``(i, x, density)``; no row without values.
    """
    v = F.col(column).cast("double")
    clean = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    st = clean.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"),
                   F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, sd = int(st.n), float(st.sd or 0.0)
    if n == 0:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    bw = sd * n ** (-1.0 / 5.0) if n > 1 and sd > 0 else 1.0
    xs = np.linspace(float(st.lo) - cut * bw, float(st.hi) + cut * bw, grid)
    points = clean.select("v", F.posexplode(F.array(*[F.lit(float(x)) for x in xs])).alias("i", "x"))
    z = (F.col("x") - F.col("v")) / F.lit(bw)
    norm = 1.0 / (n * bw * np.sqrt(2 * np.pi))
    return points.groupBy("i", "x").agg((F.sum(F.exp(-0.5 * z * z)) * F.lit(float(norm))).alias("density"))


def binned_density(df: DataFrame, column: str, grid: int = 200, cut: float = 3.0, bins: int = 4096) -> DataFrame:
    """T12 from bins: like :func:`density`, at a cost of rows + bins x grid instead of rows x grid.

    Each value gives its two nearest of ``bins`` evenly spaced points a share by its distance to them (linear binning, one
    aggregate), and the kernel goes over the points. With points h bandwidths apart no density is off by more than
    :func:`density_error` (h² / (8 sqrt(2 pi)) over the bandwidth). Output ``(i, x, density)``; no row without values.
    """
    v = F.col(column).cast("double")
    clean = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    st = clean.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, sd = int(st.n), float(st.sd or 0.0)
    if n == 0:
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    bw = sd * n ** (-1.0 / 5.0) if n > 1 and sd > 0 else 1.0
    lo, step = float(st.lo), (float(st.hi) - float(st.lo)) / (bins - 1)
    at = (F.col("v") - lo) / step if step > 0 else F.lit(0.0)
    left = F.least(F.floor(at), F.lit(bins - 2))
    shares = F.array(F.struct(left.alias("b"), (left + 1 - at).alias("w")), F.struct((left + 1).alias("b"), (at - left).alias("w")))
    points = clean.select(F.explode(shares).alias("s")).groupBy("s.b").agg(F.sum("s.w").alias("w"))
    xs = np.linspace(lo - cut * bw, float(st.hi) + cut * bw, grid)
    z = (F.col("x") - (F.col("b") * step + lo)) / F.lit(bw)
    spread = points.select("b", "w", F.posexplode(F.array(*[F.lit(float(x)) for x in xs])).alias("i", "x"))
    norm = float(1.0 / (n * bw * np.sqrt(2 * np.pi)))
    return spread.groupBy("i", "x").agg((F.sum(F.col("w") * F.exp(-0.5 * z * z)) * F.lit(norm)).alias("density"))


def density_error(bandwidth: float, spacing: float) -> float:
    """Bound of the error of :func:`binned_density`: linear interpolation of a kernel whose second derivative is at most
    1 / (sqrt(2 pi) bandwidth³)."""
    return spacing ** 2 / (8.0 * np.sqrt(2 * np.pi) * bandwidth ** 3)


def state_means(df: DataFrame, location: str, target: str) -> DataFrame:
    """T14 (choropleth table): mean target per location."""
    return group_mean(df, location, [target])

