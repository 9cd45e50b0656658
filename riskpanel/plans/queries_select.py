"""Registered feature-selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.operators import selection, store
from riskpanel.plans import proxy
from riskpanel.plans import sqlparts as S
from riskpanel.plans.registry import register, rounded
from riskpanel.session import materialize

NULLABLE_CORR = "CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


def fold_corr_sql() -> str:
    c = "corr(coalesce(value, 0.0), a_to_e_value)"
    return f"""{S.panel_long()},
fold_corr AS (SELECT fold, feature, {NULLABLE_CORR.format(c=c)} AS corr FROM panel_long GROUP BY fold, feature),
mean_corr AS (SELECT feature, avg(abs(corr)) AS mean_abs_corr FROM fold_corr GROUP BY feature)"""


def _corr_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 from the long store: rows = members with an outcome per start date."""
    domains = proxy.code_domains(spark, sf_dir)
    long, rows = proxy.claims_store(spark, sf_dir, domains=domains)
    return selection.target_corr(long, rows, ["party_id", "startdate"], "a_to_e_value",
                                 proxy.feature_names(domains), by=["fold"])


@register("target_corr", "T1", sql=f"""
WITH {fold_corr_sql()}
SELECT fold, feature, round(corr, 6) AS corr FROM fold_corr
""")
def target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of every claim feature with A/E per fold, from the
    sparse long store (zeros implicit; constant features NULL)."""
    return rounded(_corr_by_fold(spark, sf_dir))


@register("rank_corr", "T2", sql=f"""
WITH {fold_corr_sql()}
SELECT feature, round(mean_abs_corr, 6) AS mean_abs_corr FROM mean_corr
""")
def rank_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute correlation per feature across the folds."""
    return rounded(selection.rank_corr(_corr_by_fold(spark, sf_dir)))


@register("top_procedure_features", "T3 O2", sql=f"""
WITH {fold_corr_sql()}
SELECT feature, round(mean_abs_corr, 6) AS mean_abs_corr FROM mean_corr
WHERE starts_with(feature, 'ccs_') ORDER BY mean_abs_corr DESC NULLS LAST, feature LIMIT 10
""")
def top_procedure_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten procedure features with the highest mean absolute correlation."""
    ranked = selection.rank_corr(_corr_by_fold(spark, sf_dir))
    return rounded(selection.top_family(ranked, "ccs_", 10))


@register("corr_page", "O3 O1", sql=f"""
WITH {fold_corr_sql()}
SELECT feature, fold, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_value FROM fold_corr
ORDER BY abs(corr) DESC NULLS LAST, feature, fold LIMIT 100 OFFSET 100
""")
def corr_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the second hundred of the (feature, fold) correlations ranked by size."""
    c = _corr_by_fold(spark, sf_dir).withColumn("abs_value", F.abs("corr"))
    c = c.withColumn("__tie", F.concat_ws("|", "feature", F.lpad(F.col("fold").cast("string"), 3, "0")))
    return rounded(selection.page(c, "abs_value", 100, 200, tie="__tie").drop("__tie")
                   .select("feature", "fold", "corr", "abs_value"))


@register("cross_corr", "T4", sql=f"""
WITH {S.panel_long()},
f5 AS (SELECT party_id, feature, coalesce(value, 0.0) AS value, a_to_e_value FROM panel_long WHERE fold = 5),
sel AS (SELECT feature FROM (
          SELECT feature, {NULLABLE_CORR.format(c="corr(value, a_to_e_value)")} AS c FROM f5
          WHERE starts_with(feature, 'ccsr_3mos') GROUP BY feature)
        ORDER BY abs(c) DESC NULLS LAST, feature LIMIT 10),
pairs AS (SELECT a.feature, b.feature AS other,
                 {NULLABLE_CORR.format(c="corr(a.value, b.value)")} AS corr
          FROM f5 a JOIN f5 b ON a.party_id = b.party_id
          WHERE a.feature IN (SELECT feature FROM sel) AND starts_with(b.feature, 'ccs_')
          GROUP BY a.feature, b.feature)
SELECT feature, other, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr,
       CAST(row_number() OVER (PARTITION BY feature ORDER BY abs(corr) DESC NULLS LAST, other) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 15
""")
def cross_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: in the last fold, the 15 procedure features most correlated with each
    of the 10 diagnosis (3-month) features most correlated with A/E."""
    domains = proxy.code_domains(spark, sf_dir)
    names = proxy.feature_names(domains)
    last = proxy.START_DATES[-1]
    long, rows = proxy.claims_store(spark, sf_dir, [last], domains)
    rows = rows.select("party_id", "startdate", "a_to_e_value")
    long = long.join(rows.select("party_id", "startdate"), ["party_id", "startdate"])
    fam = [n for n in names if n.startswith("ccsr_3mos")]
    corr = selection.target_corr(long, rows, ["party_id", "startdate"], "a_to_e_value", fam)
    top = selection.top_k(corr.withColumn("abs_corr", F.abs("corr")), "abs_corr", 10, tie="feature")
    selected = [r.feature for r in top.select("feature").collect()]   # k names
    n_rows = rows.count()
    out = selection.cross_corr(long, ["party_id", "startdate"], selected, "ccs_",
                               [n for n in names if n.startswith("ccs_")], n_rows=n_rows, k=15)
    return rounded(out.select("feature", "other", "corr", "abs_corr", F.col("rank").cast("int").alias("rank")))


@register("cross_corr_folds", "T4", sql=f"""
WITH {S.panel_long()},
f AS (SELECT fold, party_id, feature, coalesce(value, 0.0) AS value, a_to_e_value FROM panel_long
      WHERE starts_with(feature, 'ccsr_3mos') OR starts_with(feature, 'ccs_')),
fam AS (SELECT fold, feature, {NULLABLE_CORR.format(c="corr(value, a_to_e_value)")} AS c FROM f
        WHERE starts_with(feature, 'ccsr_3mos') GROUP BY fold, feature),
sel AS (SELECT fold, feature FROM fam QUALIFY row_number() OVER (PARTITION BY fold ORDER BY abs(c) DESC NULLS LAST, feature) <= 10),
pairs AS (SELECT a.fold, a.feature, b.feature AS other, {NULLABLE_CORR.format(c="corr(a.value, b.value)")} AS corr
          FROM f a JOIN sel s ON s.fold = a.fold AND s.feature = a.feature
          JOIN f b ON b.fold = a.fold AND b.party_id = a.party_id AND starts_with(b.feature, 'ccs_')
          GROUP BY a.fold, a.feature, b.feature)
SELECT fold, feature, other, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr,
       CAST(row_number() OVER (PARTITION BY fold, feature ORDER BY abs(corr) DESC NULLS LAST, other) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 15
""")
def cross_corr_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 in every fold: the 15 procedure features most correlated with each of the fold's 10
    diagnosis (3-month) features most correlated with A/E (``cross_corr`` has the last fold)."""
    domains = proxy.code_domains(spark, sf_dir)
    names, keys = proxy.feature_names(domains), ["party_id", "startdate"]
    store = proxy.member_store(spark, sf_dir, proxy.START_DATES, domains)
    rows = materialize(proxy.outcome_rows(spark, sf_dir, store, proxy.START_DATES).select(*keys, "fold", "a_to_e_value"), "outcome_rows")
    # members' entries are joined to their fold together, before they are dealt out as cells
    long = proxy.store_long(store.join(rows.select(*keys, "fold"), keys), domains, ["fold"])
    family = F.col("feature").startswith("ccsr_3mos")
    corr = selection.target_corr(long.where(family), rows, keys, "a_to_e_value", [n for n in names if n.startswith("ccsr_3mos")], by=["fold"])
    w = Window.partitionBy("fold").orderBy(F.abs("corr").desc_nulls_last(), F.col("feature"))
    top = corr.withColumn("__k", F.row_number().over(w)).where("__k <= 10").select("fold", "feature")
    out = selection.cross_corr_by(long.where(family | F.col("feature").startswith("ccs_")), keys, "fold", top,
                                  "ccs_", [n for n in names if n.startswith("ccs_")], rows.groupBy("fold").agg(F.count("*").alias("n")))
    return rounded(out.select("fold", "feature", "other", "corr", "abs_corr", F.col("rank").cast("int").alias("rank")))


@register("null_corr_features", "A12", sql=f"""
WITH {fold_corr_sql()}
SELECT feature FROM fold_corr WHERE corr IS NULL GROUP BY feature HAVING count(DISTINCT fold) = 5
""")
def null_corr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose correlation is NULL in all five folds."""
    return selection.null_corr_features(_corr_by_fold(spark, sf_dir), 5)


@register("drop_list", "T6 U5 A9 A12", sql=f"""
WITH {fold_corr_sql()},
nc AS (SELECT feature FROM fold_corr WHERE corr IS NULL GROUP BY feature HAVING count(DISTINCT fold) = 5),
am AS (SELECT feature FROM panel_long GROUP BY feature HAVING count(nullif(value, 0)) = 0)
SELECT feature FROM am UNION SELECT feature FROM nc
""")
def drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-missing features plus features with a NULL correlation in every fold."""
    domains = proxy.code_domains(spark, sf_dir)
    names = proxy.feature_names(domains)
    long, rows = proxy.claims_store(spark, sf_dir, domains=domains)
    keys = ["party_id", "startdate"]
    # all-missing on the store: no non-zero cell for any member with an outcome
    seen = long.where(F.col("value") != 0).join(rows.select(*keys), keys).select("feature").distinct()
    am = spark.createDataFrame([(n,) for n in names], "feature string").join(seen, "feature", "left_anti")
    corr = selection.target_corr(long, rows, keys, "a_to_e_value", names, by=["fold"])
    return selection.drop_list(am, selection.null_corr_features(corr, 5))


@register("constant_features", "P11", sql=f"""
WITH {S.panel_long()}
SELECT feature AS column FROM panel_long GROUP BY feature HAVING min(value) IS NULL OR min(value) = max(value)
""")
def constant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-variance columns of the panel (the drop list of ``drop_constant``)."""
    return store.constant(proxy.panel_profile(spark, sf_dir))
