"""Reshaping and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.operators.quantiles import select_ranks
from riskpanel.session import materialize


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    """Wide -> long; rows with a NULL value are kept (unlike SQL UNPIVOT)."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def transpose(df: DataFrame, key: str, value_cols: Sequence[str] | None = None,
              name: str = "column") -> DataFrame:
    """Transpose a small result (one output column per key value).

    The key values become columns, so they are resolved first; only meant for
    report-sized frames (group means, describe output).
    """
    cols = list(value_cols or [c for c in df.columns if c != key])
    k = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))  # a NULL key is a column as well
    keys = sorted(r[0] for r in df.select(k).distinct().collect())
    long = df.select(k.alias("__k"), *cols).unpivot(["__k"], cols, name, "__v")
    return long.groupBy(name).pivot("__k", keys).agg(F.first("__v"))


def head_per_group(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every group in ``order``.

    ``row_number() <= n`` lets Spark insert a per-partition group limit before
    the shuffle (WindowGroupLimit), so at most ``n`` rows per group and input
    partition move, however large the group.
    """
    w = Window.partitionBy(group).orderBy(*[F.col(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def weighted_sample(df: DataFrame, n: int | None = None, frac: float | None = None, weight: str = "weight",
                    seed: int = 0) -> DataFrame:
    """Weighted sample without replacement (Efraimidis-Spirakis).

    Each row draws ``key = -ln(u) / w``; the sample is the ``n`` smallest keys
    (``frac``: that share of all rows). The keyed rows are written once, so the
    draw is the same in every pass; the n-th smallest key is found with the
    distributed rank selection, then a filter keeps the rows at or below it: the
    sample never passes through one task. Weight 0 (or NULL) is never drawn; with
    fewer positive weights than ``n`` all of them are.
    """
    w = F.col(weight).cast("double")
    keyed = materialize(df.withColumn("__key", F.when(w > 0, -F.log(F.rand(seed)) / w)), "weighted")
    if n is None:
        n = int(round(frac * keyed.count()))
    drawn = keyed.where(F.col("__key").isNotNull())
    if n <= 0:
        return keyed.where(F.lit(False)).drop("__key")
    row = select_ranks(drawn.select(F.col("__key").alias("__v")), [], F.array(F.lit(n - 1).cast("long"))).first()
    if row is not None:
        drawn = drawn.where(F.col("__key") <= F.lit(row["__v"]))
    return drawn.drop("__key")


def dummies(df: DataFrame, column: str, levels: Sequence[str] | None = None, drop: str | None = "first",
            prefix: str | None = None, dtype: str = "int") -> DataFrame:
    """One 0/1 column per level (sorted); ``drop='first'`` or a named level
    is left out. NULL and unseen values give all zeros."""
    if levels is None:  # a category domain: bounded, checked
        from riskpanel.operators.panel import resolve_domain
        levels = resolve_domain(df, column)
    levels = list(levels)
    if drop == "first" and levels:
        levels = levels[1:]
    elif drop is not None:
        levels = [lv for lv in levels if lv != drop]
    pre = prefix if prefix is not None else column
    c = F.col(column).cast("string")
    return df.select(*[F.col(f"`{x}`") for x in df.columns if x != column],
                     *[F.when(c == F.lit(lv), 1).otherwise(0).cast(dtype).alias(f"{pre}_{lv}") for lv in levels])
