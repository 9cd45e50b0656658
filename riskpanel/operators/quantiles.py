"""Exact quantiles without funnelling a column through one task.

``percentile`` keeps a value -> count map per group and merges it in one task,
which does not hold for a continuous column at scale. Here rows are counted first. Where a
group may be large, one approximate pass gives fixed bucket borders, literals from
then on; rows are counted per (group, bucket), which locates the bucket of every
requested rank, and the same goes on inside the located buckets until they are small. Only their
rows are then aggregated to (value, count) and ranked. Each step is an aggregate over the rows
themselves: no row position is ever computed, so the result does not depend on how a plan is
evaluated, and a value held by a third of the rows collapses in the partial aggregate.

NULL and NaN values are skipped and rows with a NULL group key are dropped, as
pandas does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.session import materialize

BUCKETS = 256


def _values(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = F.col(value).cast("double")
    out = df.select(*by, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    for b in by:
        out = out.where(F.col(b).isNotNull())
    return out


def _bucket(borders: Sequence[float], first: int = 0) -> Column:
    """Number of borders at or below the value, as a balanced tree of comparisons."""
    if not borders:
        return F.lit(first)
    mid = len(borders) // 2
    return F.when(F.col("__v") < F.lit(borders[mid]), _bucket(borders[:mid], first)) \
        .otherwise(_bucket(borders[mid + 1:], first + mid + 1))


def select_ranks(rows: DataFrame, by: Sequence[str], wanted: Column, few: int = 1_000_000) -> DataFrame:
    """``(by..., __n, __rank, __v)``: the value at each 0-based rank of the array ``wanted``
    (an expression over the group's row count ``__n``). ``rows`` holds ``by`` and ``__v``."""
    by = list(by)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*by, "__n", wanted.alias("__ranks"))
    sizes = materialize(counts, "ranks")  # one row a group
    most = sizes.agg(F.max("__n")).first()[0] or 0
    found = _ranked(rows, by, sizes.select(*by, "__ranks"), most, few, 0)
    return _with(found, sizes.select(*by, "__n"), by).select(*by, "__n", "__rank", "__v")


def _ranked(rows: DataFrame, by: list[str], ranks: DataFrame, most: int, few: int, level: int) -> DataFrame:
    """(by..., __rank, __v) for ``ranks`` (by..., __ranks); ``most``: rows of which a group may consist.

    While groups may hold over ``few`` rows, buckets are cut by approximate borders of the rows at hand, the ones that hold a
    wanted rank are located by counts, and the same is done inside them: a bucket is split until it is small, or
    consists of one value.
    """
    if most > few and level < 8:
        got = rows.agg(F.percentile_approx("__v", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("b")).first()[0]
        borders, bucket = sorted(set(got or [])), f"__b{level}"
        cut = rows.withColumn(bucket, _bucket(borders))
        counts = cut.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__c"), (F.min("__v") == F.max("__v")).alias("__one"))
        before = F.sum("__c").over(Window.partitionBy(*by).orderBy(bucket)) - F.col("__c")
        need = _with(counts.withColumn("__before", before), ranks, by)
        own = F.filter("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c")))
        need = need.withColumn("__ranks", F.transform(own, lambda r: r - F.col("__before"))).where(F.size("__ranks") > 0)
        need = materialize(need.select(*by, bucket, "__c", "__one", "__before", "__ranks"), "located")
        left = need.agg(F.max(F.when(~F.col("__one"), F.col("__c")))).first()[0] or 0
        inner = [*by, bucket]
        held = cut.join(need.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(inner)]),
                        [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(inner)], "left_semi")
        if level + 1 < 8 and left > few:
            held = materialize(held, "held")  # read again for the next borders and counts
        found = _ranked(held, inner, need.select(*inner, "__ranks"), left, few, level + 1)
        return _with(found, need.select(*inner, "__before"), inner).withColumn("__rank", F.col("__rank") + F.col("__before")) \
            .select(*by, "__rank", "__v")
    # (value, count) pairs: equal values are one row, combined before the shuffle
    held = rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    last = F.sum("__c").over(Window.partitionBy(*by).orderBy("__v"))
    held = _with(held.withColumn("__last", last), ranks, by)
    mine = F.filter("__ranks", lambda r: (r < F.col("__last")) & (r >= F.col("__last") - F.col("__c")))
    return held.select(*by, F.explode(mine).alias("__rank"), "__v")


def _with(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on ``by`` (one row of ``right`` for everything if there is none)."""
    if by:
        return left.join(right, by)
    return left.crossJoin(F.broadcast(right))  # a single row


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles (pandas / numpy default, DuckDB ``quantile_cont``).

    Output: ``by... , q_<p*100>`` one column per probability, one row per group.
    """
    def ends(p: float) -> list[Column]:
        at = (F.col("__n") - 1) * F.lit(float(p))
        return [F.floor(at).cast("long"), F.ceil(at).cast("long")]

    wanted = F.array_distinct(F.array(*[r for p in probs for r in ends(p)]))
    picked = select_ranks(_values(df, value, by), by, wanted)
    values = picked.groupBy(*by).agg(F.max("__n").alias("__n"),
                                     F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__m"))
    out = []
    for p in probs:
        at, (lo, hi) = (F.col("__n") - 1) * F.lit(float(p)), ends(p)
        a, b = F.try_element_at("__m", lo), F.try_element_at("__m", hi)
        out.append((a + (b - a) * (at - lo)).alias(f"q{round(float(p) * 100, 4):g}".replace(".", "_")))
    return values.where(F.col("__n").isNotNull()).select(*by, *out)  # no value, no row
