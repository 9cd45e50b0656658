"""Data quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(c: str):
    return F.col(f"`{c}`")


def rows_with_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows with a NULL in any of the columns."""
    cols = list(columns or df.columns)
    return df.where(reduce(lambda a, b: a | b, [_q(c).isNull() for c in cols]))


def missing(df: DataFrame, columns: Sequence[str] | None = None, only_missing: bool = False) -> DataFrame:
    """Per column, NULL count and percent, in one aggregate pass.

    ``only_missing`` keeps columns with at least one NULL; ``missing_pct == 100``
    marks all-NULL columns.
    """
    cols = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(_q(c)).alias(c) for c in cols])
    long = row.unpivot(["__n"], cols, "column", "non_null")
    out = long.select("column", (F.col("__n") - F.col("non_null")).alias("missing"),
                      (F.try_divide(F.col("__n") - F.col("non_null"), F.col("__n")) * 100.0).alias("missing_pct"))
    return out.where(F.col("missing") > 0) if only_missing else out


def all_missing(df: DataFrame, fold: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that are NULL in every row of every fold.

    ``groupBy(fold)`` non-null counts (folds x columns numbers), then the
    columns whose count is 0 everywhere.
    """
    cols = [c for c in (columns or df.columns) if c != fold]
    per = df.groupBy(fold).agg(*[F.count(_q(c)).alias(c) for c in cols])
    long = per.unpivot([fold], cols, "column", "non_null")
    return (long.groupBy("column").agg(F.max("non_null").alias("__m"))
                .where(F.col("__m") == 0).select("column"))


def info(df: DataFrame) -> DataFrame:
    """Shape, types and non-null counts: ``(column, dtype, non_null, rows)``."""
    cols = df.columns
    types = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(_q(c)).alias(c) for c in cols])
    long = row.unpivot(["__n"], cols, "column", "non_null")
    tmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return long.select("column", tmap[F.col("column")].alias("dtype"), "non_null",
                       F.col("__n").alias("rows"))


_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767),
           ("int", -2147483648, 2147483647), ("bigint", -(2 ** 63), 2 ** 63 - 1)]


def narrow_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Narrowest lossless integer type per numeric column (``to_numeric(downcast='integer')``).

    One aggregate pass: min, max, nulls and whether every value is integral.
    Columns with NULLs, NaN or fractions keep their type. Output
    ``(column, dtype, narrow_type)``.
    """
    types = dict(df.dtypes)
    cols = [c for c in (columns or df.columns)
            if types[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    aggs = []
    for c in cols:
        x = _q(c).cast("double")
        aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.sum(F.when(x.isNull() | F.isnan(x), 1).otherwise(0)).alias(f"{c}__nul"),
                 F.sum(F.when(x != F.floor(x), 1).otherwise(0)).alias(f"{c}__frac")]
    row = df.agg(*aggs)
    parts = []
    for c in cols:
        mn, mx = F.col(f"`{c}__min`"), F.col(f"`{c}__max`")
        ok = (F.col(f"`{c}__nul`") == 0) & (F.col(f"`{c}__frac`") == 0)
        pick = None
        for name, lo, hi in _RANGES:
            cond = ok & (mn >= F.lit(float(lo))) & (mx <= F.lit(float(hi)))
            pick = F.when(cond, F.lit(name)) if pick is None else pick.when(cond, F.lit(name))
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                              pick.otherwise(F.lit(types[c])).alias("narrow_type")))
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")



def narrow(df: DataFrame, columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """C3 applied: ``df`` with each column in the narrow type that :func:`narrow_types` finds in one profile pass.

    ``types`` (column -> type) applies an earlier profile to other rows, say those of a later fold. A value that would not
    survive the narrow type (a fraction, NaN, one out of its range) fails the job instead of being changed; NULL stays NULL.
    """
    have = dict(df.dtypes)
    if types is None:
        types = {r.column: r.narrow_type for r in narrow_types(df, columns).collect()}  # one row a column
    out = []
    for c in df.columns:
        x, kind = _q(c), types.get(c)
        if kind is None or kind == have[c]:
            out.append(x)
            continue
        small = x.try_cast(kind)
        kept = x.isNull() | (small.isNotNull() & (small.cast(have[c]) == x))
        lost = F.raise_error(F.concat(F.lit(f"column {c}: "), x.cast("string"), F.lit(f" does not fit {kind}")))
        out.append(F.when(kept, small).otherwise(lost.cast(kind)).alias(c))
    return df.select(*out)
