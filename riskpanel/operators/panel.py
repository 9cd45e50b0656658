"""Panel construction (A1, A6, J1, J2, W1, U1, C12, look-back windows)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def resolve_domain(df: DataFrame, column: str, extra: Sequence[str] = ()) -> list[str]:
    """Distinct, sorted category list (a code table).

    The domain becomes part of the output schema, so it is resolved before the
    plan is built; it is as large as the code table, never as large as the data.
    """
    rows = df.select(F.col(column).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().collect()
    return sorted({r.v for r in rows} | set(extra))


def pivot_names(values: Sequence[str], domain: Sequence[str]) -> list[tuple[str, str, str]]:
    """(value, category, output name) in value-major order, values sorted as text,
    names ``{value}_{category}`` lower-cased."""
    return [(v, c, f"{v}_{c}".lower()) for v in sorted(values) for c in domain]


def pivot_features(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str],
                   domain: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """A1: pivot-sum over a fixed category domain.

    One row per key; one column per (value, category) named ``{value}_{category}``
    lower-case, value-major. Categories absent from the data still get their
    columns; absent (key, category) pairs and all-NULL cells become ``fill``.
    Rows whose category is NULL or outside the domain are ignored. The
    aggregation is partial (map-side), so a hot key is combined before the shuffle.
    """
    names = pivot_names(values, domain)
    cat = F.col(category).cast("string")
    aggs = []
    for v, c, name in names:
        s = F.sum(F.when(cat == F.lit(c), F.col(v)))
        aggs.append((F.coalesce(s, F.lit(fill)) if fill is not None else s).alias(name))
    return df.where(cat.isin(list(domain))).groupBy(*keys).agg(*aggs)


def pivot_long(long: DataFrame, keys: Sequence[str], names: Sequence[str], feature: str = "feature",
               value: str = "value") -> DataFrame:
    """Long ``(keys..., feature, value)`` -> one column per listed feature name.

    Runs on the aggregated long store, so the wide projection touches one row per
    key, never the line-level data; absent cells are NULL.
    """
    return long.groupBy(*keys).pivot(feature, list(names)).agg(F.first(value))


def features_long(df: DataFrame, keys: Sequence[str], category: str, values: Sequence[str],
                  prefix: str | None = None) -> DataFrame:
    """Long store ``(keys..., feature, value)``, zeros implicit: the compute form of
    A1. Feature names equal the wide names of ``pivot_features``."""
    cat = F.lower(F.col(category).cast("string"))
    parts = [df.select(*keys, F.concat(F.lit(f"{v}_".lower()), cat).alias("feature"),
                       F.col(v).cast("double").alias("value")) for v in values]
    long = reduce(DataFrame.unionByName, parts)
    return (long.where(F.col("feature").isNotNull())
                .groupBy(*keys, "feature").agg(F.sum("value").alias("value"))
                .where(F.col("value") != 0))


def lookback(df: DataFrame, date_col: str, starts: Sequence[str], months: Sequence[int],
             values: dict[str, Column], name: str = "startdate", forward: bool = False) -> DataFrame:
    """Assign each dated row to every start date whose window holds it, and
    split its values into nested windows.

    ``forward=False``: window ``[start - m months, start)`` for each ``m`` in
    ``months``; output column ``{value}_{m}mos``. ``forward=True``: one window
    ``[start, start + max(months))``; output column ``{value}``. A row lands in at
    most ``ceil(max(months) / spacing)`` start dates, so the expansion is
    bounded by the schedule, never by the data.
    """
    d = F.to_date(F.col(date_col))
    span = max(months)
    cands = []
    for s in sorted(starts):
        sd = F.to_date(F.lit(s))
        cond = (d >= sd) & (d < F.add_months(sd, span)) if forward else (d >= F.add_months(sd, -span)) & (d < sd)
        cands.append(F.when(cond, sd))
    # explode of a fixed-size array of CASE results stays in generated code
    # (a higher-order filter over the schedule would be interpreted per row)
    pick = F.array(*cands)
    out = df.withColumn(name, F.explode(pick)).where(F.col(name).isNotNull())
    st = F.col(name)
    made: dict[str, Column] = {}
    for vname, expr in values.items():
        if forward:
            made[vname] = expr
        else:
            for m in months:
                made[f"{vname}_{m}mos"] = F.when(d >= F.add_months(st, -m), expr).otherwise(F.lit(0))
    keep = [c for c in df.columns if c not in made and c != name]
    cols = [e.alias(n) for n, e in made.items()]
    return out.select(*keep, F.date_format(st, "yyyy-MM-dd").alias(name), *cols)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_desc: Sequence[str],
                   columns: Sequence[str] | None = None) -> DataFrame:
    """The latest row per key (``ROW_NUMBER() OVER (... ORDER BY order DESC) = 1``).

    Written as ``max_by`` over a struct of the order columns: an aggregate with a
    map-side partial step, so a key holding a third of all rows is reduced inside
    each task instead of being sorted in one window partition.
    """
    columns = list(columns or [c for c in df.columns if c not in keys])
    ordering = F.struct(*[F.col(c) for c in order_desc])
    payload = F.struct(*[F.col(c) for c in columns])
    return (df.groupBy(*keys).agg(F.max_by(payload, ordering).alias("__row"))
              .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns]))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Per key and column, the first non-null value in ``order``
    (``groupby().first()`` semantics with an explicit order)."""
    columns = list(columns or [c for c in df.columns if c not in keys and c != order])
    return df.groupBy(*keys).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union by name; columns missing in a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def default_start(years_back: int = 1) -> Column:
    """Today minus ``years_back`` years as ISO text (month arithmetic, so Feb 29 is safe)."""
    return F.date_format(F.add_months(F.current_date(), -12 * years_back), "yyyy-MM-dd")
