"""Fairness audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.functions.rowwise import row_argmax
from riskpanel.functions.stats import chi2_sf
from riskpanel.session import materialize


#: A contingency table of more cells than this is an error, not a report.
MAX_CELLS = 10_000_000


def _grid(df: DataFrame, row: str, col: str) -> DataFrame:
    """The full contingency table ``(row, col, observed)``: every pair of levels, 0
    where the pair never occurs; NULL in either key is dropped.

    Counts are one aggregate, written once. The levels of either key come from it; their product is the table itself, at most
    ``MAX_CELLS`` cells, which is checked before it is made.
    """
    cells = materialize(df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
                          .groupBy(row, col).agg(F.count(F.lit(1)).alias("__o")), "cells")
    rows, cols = cells.select(row).distinct(), cells.select(col).distinct()
    r, c = rows.count(), cols.count()
    if r * c > MAX_CELLS:
        raise ValueError(f"a table of {r} x {c} cells; {MAX_CELLS} at most")
    few, many = (rows, cols) if r < c else (cols, rows)
    return many.crossJoin(F.broadcast(few)).join(cells, [row, col], "left") \
        .select(row, col, F.coalesce("__o", F.lit(0)).cast("long").alias("observed"))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Contingency counts and row-normalised shares, long form
    ``(row, col, count, row_share)``, zero cells included; NULL keys are dropped."""
    o = F.col("observed")
    return _grid(df, row, col).select(row, col, o.alias("count"),
                                      (o / F.sum(o).over(Window.partitionBy(row))).alias("row_share"))


def _cells(df: DataFrame, row: str, col: str) -> DataFrame:
    """All cells with their row, column and grand totals.

    The totals are aggregates of the contingency table itself (rows x columns levels) joined back by
    level, the grand total is one number.
    """
    o = F.col("observed").cast("double")
    grid = materialize(_grid(df, row, col), "grid")
    total = grid.agg(F.sum(o)).first()[0]
    return grid.join(grid.groupBy(row).agg(F.sum(o).alias("__r")), row).join(grid.groupBy(col).agg(F.sum(o).alias("__c")), col) \
        .select(row, col, "observed", "__r", "__c", F.lit(total).cast("double").alias("__n"))


def chi_square_cells(df: DataFrame, row: str, col: str) -> DataFrame:
    """T7 statistic without continuity correction, ``chi2 = Σ (O - E)² / E`` over the
    full table, ``dof = (r - 1)(c - 1)``."""
    e = F.col("__r") * F.col("__c") / F.col("__n")
    d = F.col("observed").cast("double") - e
    return (_cells(df, row, col)
            .agg(F.max("__n").alias("n"), F.sum(d * d / e).alias("chi2"),
                 F.countDistinct(row).alias("nr"), F.countDistinct(col).alias("nc"))
            .select(F.col("n").cast("long").alias("n"), "chi2",
                    ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("int").alias("dof")))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Statistic, degrees of freedom and p-value (upper chi-square tail)."""
    s = chi_square_cells(df, row, col)
    return s.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof")))


def expected_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    """T7 expected table ``R_i C_j / N`` of every cell, zero cells included."""
    j = _cells(df, row, col)
    return j.select(row, col, "observed", (F.col("__r") * F.col("__c") / F.col("__n")).alias("expected"))


def pairwise_chi_square(df: DataFrame, group: str, flag: str, with_p: bool = True) -> DataFrame:
    """2 x 2 chi-square (no correction) of ``flag`` for every pair of groups.

    Counts per (group, flag) are one small aggregate, written once; the pairs come
    from a self-join of that table on ``g1 < g2`` (groups x groups rows, never rows x rows).
    """
    cnt = (df.where(F.col(group).isNotNull() & F.col(flag).isNotNull())
             .groupBy(group).agg(F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).cast("double").alias("a1"),
                                 F.sum(F.when(F.col(flag) == 1, 0).otherwise(1)).cast("double").alias("a0")))
    # both sides of the pair join read the (one row per group) count table: write
    # it once so the input is aggregated once
    cnt = materialize(cnt, "group_counts")
    x = cnt.select(F.col(group).alias("g1"), F.col("a1").alias("x1"), F.col("a0").alias("x0"))
    y = cnt.select(F.col(group).alias("g2"), F.col("a1").alias("y1"), F.col("a0").alias("y0"))
    p = x.join(y, F.col("g1") < F.col("g2"))
    n = F.col("x1") + F.col("x0") + F.col("y1") + F.col("y0")
    num = n * (F.col("x1") * F.col("y0") - F.col("x0") * F.col("y1")) ** 2
    den = (F.col("x1") + F.col("x0")) * (F.col("y1") + F.col("y0")) * (F.col("x1") + F.col("y1")) * \
          (F.col("x0") + F.col("y0"))
    out = p.select("g1", "g2", n.cast("long").alias("n"), F.try_divide(num, den).alias("chi2"),
                   F.lit(1).alias("dof"))
    return out.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof"))) if with_p else out


def compare_coefficients(a: DataFrame, b: DataFrame, name: str = "feature", a_col: str = "coef_a",
                         b_col: str = "coef_b", k: int | None = 30) -> DataFrame:
    """Full outer join of two coefficient sets by name, absolute
    difference, zero-difference flag, and the ``k`` largest differences ranked
    (``k=None``: all rows, unranked)."""
    j = a.select(name, a_col).join(b.select(name, b_col), name, "outer")
    d = F.abs(F.col(a_col) - F.col(b_col))
    out = j.select(name, a_col, b_col, d.alias("coef_diff"), (d == 0).alias("zero_diff"))
    if k is None:
        return out
    order = [F.col("coef_diff").desc_nulls_last(), F.col(name)]
    top = out.orderBy(*order).limit(k)  # the rank's window holds k rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def posterior_class(df: DataFrame, tables: Sequence[tuple[str, DataFrame]], classes: Sequence[str],
                    prior: dict[str, float] | None = None, out: str = "predicted") -> DataFrame:
    """M8 (re-aimed): class posterior from independent lookup tables (naive Bayes).

    Each table maps a key column of ``df`` to one probability column per class
    (``p_<class>``). The posterior is the normalised product (times an optional
    prior); a key missing from a table leaves that factor out. The predicted
    class is the arg-max, the first class winning ties. Whether a table is broadcast
    is left to its size statistics and AQE.
    """
    cur = df
    factors = {c: F.lit(float(prior[c]) if prior else 1.0) for c in classes}
    for i, (key, tbl) in enumerate(tables):
        t = tbl.select(F.col(key).alias(f"__k{i}"), *[F.col(f"p_{c}").alias(f"__t{i}_{c}") for c in classes])
        cur = cur.join(t, cur[key] == t[f"__k{i}"], "left").drop(f"__k{i}")
        for c in classes:
            factors[c] = factors[c] * F.coalesce(F.col(f"__t{i}_{c}"), F.lit(1.0))
    total = sum((factors[c] for c in classes), F.lit(0.0))
    post = {c: F.try_divide(factors[c], total) for c in classes}
    cur = cur.select(*df.columns, *[post[c].alias(f"post_{c}") for c in classes])
    return cur.withColumn(out, row_argmax([f"post_{c}" for c in classes], list(classes)))


def logit_summary(df: DataFrame, features: Sequence[str], label: str, fit_intercept: bool = False,
                  max_iter: int = 100) -> DataFrame:
    """Logistic regression with standard errors, z and p-values
    (``GeneralizedLinearRegression`` binomial / logit, IRLS)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    va = VectorAssembler(inputCols=list(features), outputCol="__x")
    data = va.transform(df.select(*features, F.col(label).cast("double").alias("__y")))
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__x", labelCol="__y",
                                      fitIntercept=fit_intercept, maxIter=max_iter)
    m = glr.fit(data)
    s = m.summary
    names = list(features) + (["intercept"] if fit_intercept else [])
    coefs = list(m.coefficients) + ([m.intercept] if fit_intercept else [])
    rows = list(zip(names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues))
    return df.sparkSession.createDataFrame(
        [(n, float(c), float(se), float(z), float(p)) for n, c, se, z, p in rows],
        "feature string, coef double, std_err double, z double, p_value double")


def ablate_column(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
                  sensitive: str, max_iter: int = 1000) -> DataFrame:
    """M6: L2 logistic regression (C = 1) with and without a sensitive column;
    coefficients side by side (``coef_with``, ``coef_without``) by feature name.

    Numerics are centred and scaled by the population std, categoricals one-hot
    with the first level dropped; ``regParam = 1 / n`` reproduces C = 1.
    """
    from pyspark.ml.classification import LogisticRegression
    from riskpanel.ml.models import fit_preprocessor

    # two preprocessors and two iterative fits read the same rows: write them once
    df = materialize(df.select(*numeric, *categorical, sensitive, label), "ablation_input")
    n = df.count()

    def fit(cats):
        prep = fit_preprocessor(df, numeric, cats, center=True)
        data = prep.transform(df).select("features", F.col(label).cast("double").alias("label"))
        lr = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
                                maxIter=max_iter, tol=1e-8)
        m = lr.fit(data)
        names = prep.feature_names
        return df.sparkSession.createDataFrame([(nm, float(c)) for nm, c in zip(names, m.coefficients)],
                                               "feature string, coef double")

    with_s = fit(list(categorical) + [sensitive]).withColumnRenamed("coef", "coef_with")
    without = fit(list(categorical)).withColumnRenamed("coef", "coef_without")
    return compare_coefficients(with_s, without, "feature", "coef_with", "coef_without", k=None)


def class_table(df: DataFrame, key: str, cls: str, classes: Sequence[str], given: str = "key") -> DataFrame:
    """Probability table ``(key, p_<class>...)`` from labelled rows.

    ``given='key'``: P(class | key) = n(key, class) / n(key);
    ``given='class'``: P(key | class) = n(key, class) / n(class).
    Counts are one aggregate by key with a column a class; class totals are a one-row aggregate.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(cls).isNotNull())
    label = F.col(cls).cast("string")
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"), *[F.count(F.when(label == F.lit(k), 1)).alias(f"__n{i}") for i, k in enumerate(classes)])
    if given == "key":
        return counts.select(key, *[(F.col(f"__n{i}") / F.col("__n")).alias(f"p_{k}") for i, k in enumerate(classes)])
    totals = rows.agg(*[F.count(F.when(label == F.lit(k), 1)) for k in classes]).first()  # one number a class
    return counts.select(key, *[F.coalesce(F.try_divide(F.col(f"__n{i}"), F.lit(totals[i])), F.lit(0.0)).alias(f"p_{k}") for i, k in enumerate(classes)])


def name_key(col: Column | str) -> Column:
    """A name as the tables have it: its letters A to Z in upper case; NULL if it has none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), F.lit(""))


def class_with_fallback(df: DataFrame, surname: tuple[str, DataFrame], first: tuple[str, DataFrame], place: tuple[str, DataFrame],
                        classes: Sequence[str], out: str = "predicted") -> DataFrame:
    """M8 from three tables: P(class | surname) P(first name | class) P(place | class), normalised, where all three keys are in
    their tables; else the product of surname and place, where both are; else NULL.

    The choice is made row by row and named in ``factors`` (3, 2 or NULL). Each pair is a key column of ``df`` and a table of the
    same key column with ``p_<class>`` columns (:func:`class_table`). Names are matched by :func:`name_key`, places as they are; a table
    may have several spellings of a name: they must agree on one key, as a duplicate key is an error.
    """
    cur = df
    for i, (key, tbl) in enumerate((surname, first, place)):
        own = name_key if i < 2 else F.col
        t = tbl.select(own(key).alias(f"__k{i}"), *[F.col(f"p_{c}").alias(f"__t{i}_{c}") for c in classes]).where(F.col(f"__k{i}").isNotNull())
        twice = t.groupBy(f"__k{i}").count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"table of {key} has keys twice: {[r[0] for r in twice]}")
        cur = cur.join(t, own(key) == F.col(f"__k{i}"), "left")
    both = F.col("__k0").isNotNull() & F.col("__k2").isNotNull()
    three = both & F.col("__k1").isNotNull()
    products = [{c: F.col(f"__t0_{c}") * F.col(f"__t2_{c}") * (F.col(f"__t1_{c}") if n == 3 else 1.0) for c in classes} for n in (3, 2)]
    totals = [sum((p[c] for c in classes), F.lit(0.0)) for p in products]
    # a product that is zero for every class says nothing: the other one, then NULL
    use = F.when(three & (totals[0] > 0), 3).when(both & (totals[1] > 0), 2)
    post = [F.when(use == 3, products[0][c] / totals[0]).when(use == 2, products[1][c] / totals[1]).alias(f"post_{c}") for c in classes]
    cur = cur.select(*df.columns, *post, use.alias("factors"))
    return cur.withColumn(out, row_argmax([f"post_{c}" for c in classes], list(classes)))
