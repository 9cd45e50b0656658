"""Feature selection.

Correlations are computed from the long store ``(keys..., feature, value)``
with zeros implicit: N, Σy and Σy² come from the row table, Σx, Σx² and Σxy
from the non-zero feature rows joined to their row's target. No wide frame
with thousands of ``corr`` expressions is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.stats import corr_sparse, corr_support
from riskpanel.session import materialize


def target_corr(long: DataFrame, rows: DataFrame, keys: Sequence[str], target: str,
                features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every feature with the target, per group ``by``.

    ``long`` holds the non-zero feature values; ``rows`` one row per key with the
    target. Every listed feature gets a row per group (NULL when it is constant,
    e.g. all zero), matching a dense ``corrwith`` after ``fillna(0)``.
    """
    y = F.col(target).cast("double")
    base = rows.select(*keys, *[b for b in by if b not in keys], y.alias("__y"))
    stats = base.groupBy(*by).agg(F.count("__y").cast("double").alias("n"), F.avg("__y").alias("my"),
                                  (F.var_pop("__y") * F.count("__y")).alias("ssy"))
    x = F.col("value").cast("double")
    sums = (long.select(*keys, "feature", "value").where(F.col("feature").isin(list(features))).join(base.where(F.col("__y").isNotNull()), list(keys))
                .where(F.col("value").isNotNull()).groupBy(*by, "feature")
                .agg(F.count("value").cast("double").alias("n1"), F.avg(x).alias("mx1"),
                     (F.var_pop(x) * F.count("value")).alias("ssx1"), F.avg("__y").alias("my1"),
                     (F.covar_pop(x, F.col("__y")) * F.count("value")).alias("co1")))
    grid = stats.select(*by, "n", "my", "ssy", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    j = grid.join(sums, [*by, "feature"], "left").fillna(0.0, subset=["n1", "mx1", "ssx1", "my1", "co1"])
    c = F.col
    return j.select(*by, "feature", corr_sparse(c("n"), c("my"), c("ssy"), c("n1"), c("mx1"), c("ssx1"),
                                                c("my1"), c("co1")).alias("corr"))


def rank_corr(corr: DataFrame, feature: str = "feature", value: str = "corr") -> DataFrame:
    """Mean absolute correlation per feature across folds (NULLs skipped)."""
    return corr.groupBy(feature).agg(F.avg(F.abs(value)).alias("mean_abs_corr"))


def top_k(df: DataFrame, order: str, k: int, ascending: bool = False, tie: str | None = None) -> DataFrame:
    """O2: the first ``k`` rows by ``order`` (ties broken by ``tie``); a TakeOrdered plan."""
    o = F.col(order).asc_nulls_last() if ascending else F.col(order).desc_nulls_last()
    cols = [o] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*cols).limit(k)


def page(df: DataFrame, order: str, start: int, stop: int, ascending: bool = False,
         tie: str | None = None) -> DataFrame:
    """O3: rows ``start .. stop-1`` of the ranking (``iloc[start:stop]``)."""
    o = F.col(order).asc_nulls_last() if ascending else F.col(order).desc_nulls_last()
    cols = [o] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*cols).offset(start).limit(stop - start)


def top_family(ranked: DataFrame, prefix: str, k: int, feature: str = "feature",
               order: str = "mean_abs_corr") -> DataFrame:
    """The top ``k`` features of one family (name prefix)."""
    return top_k(ranked.where(F.col(feature).startswith(prefix)), order, k, tie=feature)


def cross_corr(long: DataFrame, keys: Sequence[str], selected: Sequence[str], other_prefix: str,
               other_features: Sequence[str], n_rows: int, k: int = 15) -> DataFrame:
    """T4: for each selected feature, the ``k`` features of another family most
    correlated with it (by absolute correlation, ties by name): :func:`cross_corr_by` with one group."""
    spark = long.sparkSession
    chosen = spark.createDataFrame([(0, f) for f in selected], "__one int, feature string")
    rows = spark.createDataFrame([(0, int(n_rows))], "__one int, n long")
    return cross_corr_by(long.withColumn("__one", F.lit(0)), keys, "__one", chosen, other_prefix, other_features, rows, k).drop("__one")


def cross_corr_by(long: DataFrame, keys: Sequence[str], by: str, selected: DataFrame, other_prefix: str,
                  other_features: Sequence[str], n_rows: DataFrame, k: int = 15) -> DataFrame:
    """T4 per group ``by``, with a selection (by, feature) and a row count (by, n) of each group.

    ``long`` holds ``by``. Values are taken less their feature's mean over the rows that hold it. The cells in use are written
    once; those of a key are gathered into two lists by one shuffle (the selected ones, never longer than the selection,
    and those of the other family), and sums are per (group, selected, other).
    """
    x = F.col("value").cast("double")
    cells = long.select(by, *keys, "feature", x.alias("value")).where("value IS NOT NULL")
    selected = materialize(selected.select(by, "feature"), "selected")
    chosen = selected.distinct().withColumn("__own", F.lit(True))
    family = F.col("feature").startswith(other_prefix)
    used = cells.join(F.broadcast(chosen), [by, "feature"], "left").where(family | F.col("__own"))  # a selection is schema-sized
    used = materialize(used, "feature_cells")
    means = materialize(used.groupBy(by, "feature").agg(F.avg("value").alias("at")), "feature_means")  # a row a group and feature
    centred = used.join(means, [by, "feature"]).withColumn("value", F.col("value") - F.col("at"))
    stats = materialize(centred.groupBy(by, "feature").agg(
        F.count("*").cast("double").alias("n1"), F.max("at").alias("at"), F.sum("value").alias("own"), F.sum(x * x).alias("sq")), "feature_moments")
    entry = F.struct("feature", "value")
    lists = centred.dropna(subset=list(keys)).groupBy(by, *keys).agg(
        F.collect_list(F.when(F.col("__own"), entry)).alias("__own"), F.collect_list(F.when(family, entry)).alias("__other"))
    both = lists.where("size(__own) > 0").select(by, "__own", F.explode("__other").alias("b")) \
        .select(by, F.col("b.feature").alias("other"), F.col("b.value").alias("value"), F.explode("__own").alias("a"))
    ab = both.groupBy(by, F.col("a.feature").alias("feature"), "other").agg(
        F.count("*").cast("double").alias("n_ab"), F.sum("a.value").alias("sum_a"), F.sum("value").alias("sum_b"),
        F.sum(F.col("value") * F.col("a.value")).alias("sum_ab"))
    names = F.explode(F.array(*[F.lit(f) for f in other_features])).alias("other")
    grid = selected.select(by, "feature", names).join(n_rows.select(by, F.col("n").cast("double").alias("n")), by)
    moments = ["n1", "at", "own", "sq"]
    a_stats = stats.select(by, "feature", *[F.col(m).alias(f"{m}_a") for m in moments])
    b_stats = stats.select(by, F.col("feature").alias("other"), *[F.col(m).alias(f"{m}_b") for m in moments])
    sums = [*[f"{m}_{s}" for s in "ab" for m in moments], "n_ab", "sum_a", "sum_b", "sum_ab"]
    pairs = grid.join(a_stats, [by, "feature"], "left").join(b_stats, [by, "other"], "left") \
        .join(ab, [by, "feature", "other"], "left").fillna(0.0, subset=sums)
    c = corr_support(F.col("n"), *[F.col(v) for v in sums])
    out = pairs.select(by, "feature", "other", c.alias("corr"), F.abs(c).alias("abs_corr"))
    w = Window.partitionBy(by, "feature").orderBy(F.col("abs_corr").desc_nulls_last(), F.col("other"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def null_corr_features(corr: DataFrame, n_folds: int, fold: str = "fold", feature: str = "feature",
                       value: str = "corr") -> DataFrame:
    """Features whose correlation is NULL in ``n_folds`` distinct folds."""
    return (corr.where(F.col(value).isNull()).groupBy(feature)
                .agg(F.countDistinct(fold).alias("__k")).where(F.col("__k") == n_folds).select(feature))


def drop_list(all_missing: DataFrame, null_corr: DataFrame) -> DataFrame:
    """Union of the all-missing columns and the null-correlation features."""
    return (all_missing.select(F.col(all_missing.columns[0]).alias("feature"))
            .union(null_corr.select(F.col(null_corr.columns[0]).alias("feature"))).distinct())


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P11 profile: columns with at most one distinct non-null value (min = max or all NULL)."""
    cols = list(columns or df.columns)
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`")
        aggs.append(F.when(F.min(x).isNull() | (F.min(x) == F.max(x)), F.lit(True)).otherwise(F.lit(False)).alias(c))
    row = df.agg(*aggs)
    return row.unpivot([], cols, "column", "constant").where(F.col("constant")).select("column")


def drop_constant(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Remove zero-variance columns (the list is schema-sized)."""
    const = [r.column for r in constant_columns(df, columns).collect()]
    return df.drop(*const)
