"""Registered fairness and reshaping queries (A11, T7, T8, M7, M8, T13, M6, U3, U6,
U7, P3, P6, P8, P12, P14, P15, C8-C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions.binning import flag
from riskpanel.functions.rowwise import row_argmax, row_mean
from riskpanel.ml.scoring import align
from riskpanel.operators import columns, fairness, profile, reshape, selection
from riskpanel.plans import proxy
from riskpanel.plans import sqlparts as S
from riskpanel.plans.queries_select import _corr_by_fold
from riskpanel.plans.registry import register, rounded
from riskpanel.session import materialize

THRESHOLD_PAIRS = f"""{S.pairs()},
t AS (SELECT *, CASE WHEN y_prior <= 1 THEN 1 ELSE 0 END AS threshold FROM pairs)"""


def _flagged(spark: SparkSession, sf_dir: str, written: bool = False) -> DataFrame:
    """Scored set with the acceptance flag (score <= 1); ``written`` for multi-pass use."""
    src = proxy.scored_table(spark, sf_dir) if written else proxy.score_pairs(spark, sf_dir)
    return src.withColumn("threshold", flag("y_prior", "<=", 1))


@register("crosstab_threshold", "A11 C13 W3", sql=f"""
WITH {THRESHOLD_PAIRS},
c AS (SELECT state, threshold, count(*) AS count FROM t GROUP BY ALL)
SELECT state, threshold, count, round(count / sum(count) OVER (PARTITION BY state), 6) AS row_share FROM c
""")
def crosstab_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State x acceptance flag counts, row-normalised."""
    return rounded(fairness.crosstab(_flagged(spark, sf_dir), "state", "threshold"))


@register("chi_square_state", "T7", sql=f"""
WITH {THRESHOLD_PAIRS},
cells AS (SELECT state, threshold, count(*)::DOUBLE AS o FROM t GROUP BY ALL),
rs AS (SELECT state, sum(o) AS r FROM cells GROUP BY 1),
cs AS (SELECT threshold, sum(o) AS c FROM cells GROUP BY 1),
tot AS (SELECT sum(o) AS n FROM cells),
grid AS (SELECT rs.state, cs.threshold, tot.n, rs.r * cs.c / tot.n AS e FROM rs CROSS JOIN cs CROSS JOIN tot)
SELECT CAST(max(g.n) AS BIGINT) AS n, round(sum((coalesce(c.o, 0) - g.e) * (coalesce(c.o, 0) - g.e) / g.e), 6) AS chi2,
       CAST((count(DISTINCT g.state) - 1) * (count(DISTINCT g.threshold) - 1) AS INTEGER) AS dof
FROM grid g LEFT JOIN cells c ON c.state = g.state AND c.threshold = g.threshold
""")
def chi_square_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square statistic (no correction) and degrees of freedom, state x flag."""
    return rounded(fairness.chi_square_cells(_flagged(spark, sf_dir), "state", "threshold"))


@register("pairwise_chi_square", "T8", sql=f"""
WITH {THRESHOLD_PAIRS},
cnt AS (SELECT state, sum(threshold)::DOUBLE AS a1, sum(1 - threshold)::DOUBLE AS a0 FROM t GROUP BY state)
SELECT x.state AS g1, y.state AS g2, CAST(x.a1 + x.a0 + y.a1 + y.a0 AS BIGINT) AS n,
       round((x.a1 + x.a0 + y.a1 + y.a0) * (x.a1 * y.a0 - x.a0 * y.a1) * (x.a1 * y.a0 - x.a0 * y.a1)
             / ((x.a1 + x.a0) * (y.a1 + y.a0) * (x.a1 + y.a1) * (x.a0 + y.a0)), 6) AS chi2,
       1 AS dof
FROM cnt x JOIN cnt y ON x.state < y.state
""")
def pairwise_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 chi-square of the flag for every pair of states."""
    return rounded(fairness.pairwise_chi_square(_flagged(spark, sf_dir), "state", "threshold", with_p=False))


@register("chi_square_pvalues", "T7 T8")
def chi_square_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 + T8 with p-values (upper chi-square tail, Arrow-batched UDF on the
    few statistic rows); rows-only check since the oracle has no erfc."""
    f = _flagged(spark, sf_dir, written=True)
    overall = fairness.chi_square(f, "state", "threshold").select(
        F.lit("*").alias("g1"), F.lit("*").alias("g2"), "n", "chi2", "dof", "p_value")
    pairs = fairness.pairwise_chi_square(f, "state", "threshold")
    return overall.unionByName(pairs)


@register("compare_coefficients", "M7 J5", sql=f"""
WITH {__import__("riskpanel.plans.queries_select", fromlist=["x"]).fold_corr_sql()},
a AS (SELECT feature, corr AS coef_a FROM fold_corr WHERE fold = 1 AND corr IS NOT NULL),
b AS (SELECT feature, corr AS coef_b FROM fold_corr WHERE fold = 2 AND corr IS NOT NULL),
j AS (SELECT coalesce(a.feature, b.feature) AS feature, a.coef_a, b.coef_b, abs(a.coef_a - b.coef_b) AS d
      FROM a FULL OUTER JOIN b ON a.feature = b.feature)
SELECT feature, round(coef_a, 6) AS coef_a, round(coef_b, 6) AS coef_b, round(d, 6) AS coef_diff,
       d = 0 AS zero_diff, CAST(row_number() OVER (ORDER BY d DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM j QUALIFY rank <= 30
""")
def compare_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: two coefficient sets (per-feature A/E correlations of folds 1 and 2)
    compared by full outer join: absolute difference, zero flag, top 30."""
    c = _corr_by_fold(spark, sf_dir).where(F.col("corr").isNotNull())
    a = c.where(F.col("fold") == 1).select("feature", F.col("corr").alias("coef_a"))
    b = c.where(F.col("fold") == 2).select("feature", F.col("corr").alias("coef_b"))
    out = fairness.compare_coefficients(a, b, "feature", "coef_a", "coef_b", k=30)
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))


@register("posterior_quality", "M8 P15", sql="""
WITH ld AS (SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS VARCHAR) AS q
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
pl AS (SELECT lang, avg(CASE WHEN q = '0' THEN 1.0 ELSE 0.0 END) AS p_0,
              avg(CASE WHEN q = '1' THEN 1.0 ELSE 0.0 END) AS p_1 FROM ld WHERE lang IS NOT NULL GROUP BY lang),
cc AS (SELECT q, count(*) AS n FROM ld GROUP BY q),
ps AS (SELECT source,
              sum(CASE WHEN q = '0' THEN 1 ELSE 0 END) / (SELECT max(n) FROM cc WHERE q = '0') AS p_0,
              sum(CASE WHEN q = '1' THEN 1 ELSE 0 END) / (SELECT max(n) FROM cc WHERE q = '1') AS p_1
       FROM ld WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT d.doc_id, d.lang, d.source,
             coalesce(pl.p_0, 1.0) * coalesce(ps.p_0, 1.0) AS f0, coalesce(pl.p_1, 1.0) * coalesce(ps.p_1, 1.0) AS f1
      FROM documents d LEFT JOIN pl ON d.lang = pl.lang LEFT JOIN ps ON d.source = ps.source),
p AS (SELECT doc_id, lang, source,
             CASE WHEN f0 + f1 = 0 THEN NULL ELSE f0 / (f0 + f1) END AS post_0,
             CASE WHEN f0 + f1 = 0 THEN NULL ELSE f1 / (f0 + f1) END AS post_1 FROM f)
SELECT doc_id, lang, source, round(post_0, 6) AS post_0, round(post_1, 6) AS post_1,
       CASE WHEN post_0 = greatest(post_0, post_1) THEN '0' WHEN post_1 = greatest(post_0, post_1) THEN '1' END
         AS predicted
FROM p
""")
def posterior_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 re-aimed: naive-Bayes class posterior from two lookup tables learned on
    labelled rows (P(class | lang), P(source | class)), then arg-max (P15)."""
    docs = proxy.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = proxy.table(spark, sf_dir, "labels").select("doc_id", "quality")
    ld = docs.join(lab, "doc_id")
    classes = ["0", "1"]
    p_lang = fairness.class_table(ld, "lang", "quality", classes, given="key")
    p_src = fairness.class_table(ld, "source", "quality", classes, given="class")
    return rounded(fairness.posterior_class(docs, [("lang", p_lang), ("source", p_src)], classes))


_WORD = "upper(regexp_extract(text, '[A-Za-z]+'))"


@register("posterior_fallback", "M8 P15", sql=f"""
WITH d AS (SELECT doc_id, lang AS surname, nullif({_WORD}, '') AS first, length(text) // 2000 AS place FROM documents),
ld AS (SELECT d.*, CAST(quality AS VARCHAR) AS q FROM d JOIN labels USING (doc_id)),
n AS (SELECT count(*) FILTER (q = '0') AS n0, count(*) FILTER (q = '1') AS n1 FROM ld),
s AS (SELECT surname, count(*) FILTER (q = '0') / count(*) AS p0, count(*) FILTER (q = '1') / count(*) AS p1 FROM ld WHERE surname IS NOT NULL AND q IS NOT NULL GROUP BY 1),
f AS (SELECT first, count(*) FILTER (q = '0') / max(n0) AS p0, count(*) FILTER (q = '1') / max(n1) AS p1 FROM ld, n WHERE first IS NOT NULL AND q IS NOT NULL GROUP BY 1),
g AS (SELECT place, count(*) FILTER (q = '0') / max(n0) AS p0, count(*) FILTER (q = '1') / max(n1) AS p1 FROM ld, n WHERE place IS NOT NULL AND q IS NOT NULL GROUP BY 1),
j AS (SELECT d.*, s.p0 * f.p0 * g.p0 AS a0, s.p1 * f.p1 * g.p1 AS a1, s.p0 * g.p0 AS b0, s.p1 * g.p1 AS b1
      FROM d LEFT JOIN s USING (surname) LEFT JOIN f USING (first) LEFT JOIN g USING (place)),
u AS (SELECT *, CASE WHEN a0 + a1 > 0 THEN 3 WHEN b0 + b1 > 0 THEN 2 END AS factors FROM j),
p AS (SELECT *, CASE factors WHEN 3 THEN a0 / (a0 + a1) WHEN 2 THEN b0 / (b0 + b1) END AS post_0,
             CASE factors WHEN 3 THEN a1 / (a0 + a1) WHEN 2 THEN b1 / (b0 + b1) END AS post_1 FROM u)
SELECT doc_id, surname, first, place, round(post_0, 6) AS post_0, round(post_1, 6) AS post_1, factors,
       CASE WHEN post_0 = greatest(post_0, post_1) THEN '0' WHEN post_1 = greatest(post_0, post_1) THEN '1' END AS predicted FROM p
""")
def posterior_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 from three tables learned on labelled rows, with the two-table product where the first word is unknown
    and NULL where the length class is (lang, first word and length stand in for surname, first name and place)."""
    docs = proxy.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("surname"), fairness.name_key(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("first"),
        F.floor(F.length("text") / 2000).alias("place"))
    known = docs.join(proxy.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    classes = ["0", "1"]
    tables = [(key, fairness.class_table(known, key, "quality", classes, given=given))
              for key, given in (("surname", "key"), ("first", "class"), ("place", "class"))]
    return rounded(fairness.class_with_fallback(docs, *tables, classes))


@register("logit_threshold", "T13 P11 P12")
def logit_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit of the acceptance flag on the blend score and plan dummies, no
    intercept, constant columns removed first; coefficients with std. errors, z, p."""
    f = _flagged(spark, sf_dir, written=True).select("y_blend", "plan", "threshold")
    d = reshape.dummies(f, "plan", drop="first", dtype="double")
    feats = [c for c in d.columns if c not in ("threshold",)]
    d = selection.drop_constant(d, feats)
    feats = [c for c in d.columns if c != "threshold"]
    return fairness.logit_summary(d, feats, "threshold", fit_intercept=False)


@register("ablation_state", "M6 M7")
def ablation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: L2 logistic models of the flag with and without the state column."""
    pol = proxy.policies(spark, sf_dir).where(F.col("plan").isin(proxy.KEPT_PLANS))
    pol = pol.withColumn("threshold", flag("a_to_e_value", "<=", 1)).fillna(0, subset=[
        "claims_3mos", "claims_6mos", "claims_12mos"])
    return fairness.ablate_column(pol, ["claims_3mos", "claims_6mos", "claims_12mos"], ["plan", "gender"],
                                  "threshold", "state", max_iter=1000)


# ------------------------------------------------------------------ reshape

_STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


@register("transpose_describe", "U3 A5", sql="""
WITH d AS (
    SELECT event_type, count(value)::DOUBLE AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
           round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
           round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
           round(max(value), 6) AS max
    FROM events WHERE event_type IS NOT NULL GROUP BY event_type),
u AS (FROM d UNPIVOT INCLUDE NULLS (v FOR stat IN (count, mean, std, min, p25, p50, p75, max)))
SELECT stat, max(CASE WHEN event_type = 'click' THEN v END) AS click, max(CASE WHEN event_type = 'error' THEN v END) AS error,
       max(CASE WHEN event_type = 'purchase' THEN v END) AS purchase, max(CASE WHEN event_type = 'signup' THEN v END) AS signup,
       max(CASE WHEN event_type = 'view' THEN v END) AS view
FROM u GROUP BY stat
""")
def transpose_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """describe() per event type, transposed (one column per event type)."""
    ev = proxy.table(spark, sf_dir, "events").where(F.col("event_type").isNotNull())
    d = rounded(profile.describe(ev, ["value"], by=["event_type"]))
    d = d.select("event_type", *[F.col(s).cast("double").alias(s) for s in _STATS])
    return reshape.transpose(d, "event_type", _STATS, name="stat")


@register("weighted_sample_orders", "U6")
def weighted_sample_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 % of orders drawn without replacement, weighted by total price."""
    o = proxy.table(spark, sf_dir, "orders")
    return reshape.weighted_sample(o, frac=0.1, weight="o_totalprice", seed=7)


@register("head_per_fold", "U7", sql=f"""
WITH {S.population()}
SELECT party_id, fold, round(a_to_e_value, 6) AS a_to_e_value FROM pop
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY party_id) <= 100
""")
def head_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 members (by id) of every fold."""
    pol = proxy.policies(spark, sf_dir).select("party_id", "fold", "a_to_e_value")
    return rounded(reshape.head_per_group(pol, "fold", ["party_id"], 100))


@register("plan_dummies", "P12 U2", sql=f"""
WITH {S.population()},
f1 AS (SELECT * FROM pop),
pl AS (SELECT DISTINCT plan AS lv FROM f1 WHERE plan IS NOT NULL),
ml AS (SELECT DISTINCT marketing_channel AS lv FROM f1 WHERE marketing_channel IS NOT NULL)
SELECT f1.party_id, f1.fold, 'plan_' || pl.lv AS dummy, CAST(CASE WHEN f1.plan = pl.lv THEN 1 ELSE 0 END AS INTEGER) AS value
FROM f1 CROSS JOIN pl WHERE pl.lv > (SELECT min(lv) FROM pl)
UNION ALL
SELECT f1.party_id, f1.fold, 'marketing_channel_' || ml.lv,
       CAST(CASE WHEN f1.marketing_channel = ml.lv THEN 1 ELSE 0 END AS INTEGER)
FROM f1 CROSS JOIN ml WHERE ml.lv > (SELECT min(lv) FROM ml)
""")
def plan_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 columns per level, first level dropped, NULL -> zeros."""
    # level resolution and the projection both read the rows: write them once
    pol = materialize(proxy.policies(spark, sf_dir)
                      .select("party_id", "fold", "plan", "marketing_channel"), "dummies_input")
    d = reshape.dummies(reshape.dummies(pol, "plan"), "marketing_channel")
    cols = [c for c in d.columns if c not in ("party_id", "fold")]
    return reshape.melt(d, ["party_id", "fold"], cols, "dummy", "value")


@register("score_argmax", "P14 P15", sql=f"""
WITH {S.pairs()}
SELECT party_id, startdate,
       CASE WHEN y_test = greatest(y_test, y_prior, y_blend) THEN 'y_test'
            WHEN y_prior = greatest(y_test, y_prior, y_blend) THEN 'y_prior'
            WHEN y_blend = greatest(y_test, y_prior, y_blend) THEN 'y_blend' END AS top_series,
       round((coalesce(y_test, 0.0) + coalesce(y_prior, 0.0) + coalesce(y_blend, 0.0))
             / ((y_test IS NOT NULL)::INT + (y_prior IS NOT NULL)::INT + (y_blend IS NOT NULL)::INT), 6) AS row_mean
FROM pairs
""")
def score_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which series is largest per row (first wins ties) and the row mean."""
    p = proxy.score_pairs(spark, sf_dir)
    cols = ["y_test", "y_prior", "y_blend"]
    return rounded(p.select("party_id", "startdate", row_argmax(cols).alias("top_series"),
                            row_mean(cols).alias("row_mean")))


@register("feature_labels", "P6 P3 C8 C9", sql=f"""
WITH dom AS ({S.DOM_CCS}),
names AS (SELECT lower('ccs_12mos_' || cat) AS feature FROM dom),
labels AS (SELECT DISTINCT lower(p_brand) AS code, upper(replace(p_brand, 'Brand#', 'B')) AS label FROM part)
SELECT n.feature, coalesce(regexp_extract(n.feature, '[^_]*$') || ' - ' || l.label, n.feature) AS labelled
FROM names n LEFT JOIN labels l ON regexp_extract(n.feature, '[^_]*$') = l.code
""")
def feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12-month procedure features, matched by name among all of the panel (P3), relabelled ``code - label``."""
    names = proxy.feature_names(proxy.code_domains(spark, sf_dir))
    panel = spark.createDataFrame([], ", ".join(f"`{n}` double" for n in names))  # its columns, without its rows
    frame = spark.createDataFrame([(n,) for n in columns.matching(panel, regex="^ccs_12mos")], "feature string")
    part = proxy.table(spark, sf_dir, "part")
    labels = part.select(F.lower("p_brand").alias("code"),
                         F.upper(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("B"))).alias("label")).distinct()
    return columns.label_features(frame, labels, "feature", "code", "label")


ALIGN_DROP, ALIGN_ABSENT = "drg_los_050", "drg_los_999"


@register("align_batch", "P8 C10", sql=f"""
WITH {S.LINES}, {S.cpt_lines(["2000-01-01"])}, {S.DRG_LONG},
{S.block_long("drgp", "drg", S.DOM_DRG, ["drg_los"])}
SELECT party_id, CASE WHEN feature = 'drg_los_zzz' THEN 'drg_los_zzz_0' ELSE feature END AS feature,
       round(value, 6) AS value
FROM drgp_long WHERE feature <> '{ALIGN_DROP}'
UNION ALL
SELECT DISTINCT party_id, '{ALIGN_ABSENT}', 0.0 FROM drgp_long
""")
def align_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new batch (one start date) aligned to a model's feature list: a
    renamed ``.0`` column, a missing feature added as 0, an extra one dropped."""
    domains = proxy.code_domains(spark, sf_dir)
    batch = proxy.pivots(spark, sf_dir, ["2000-01-01"], domains)["drg"].drop("startdate")
    batch = batch.withColumnRenamed("drg_los_zzz", "drg_los_zzz.0")
    model_feats = [c for c in batch.columns if c not in ("party_id", "drg_los_zzz.0", ALIGN_DROP)]
    model_feats += ["drg_los_zzz_0", ALIGN_ABSENT]
    aligned = align(batch, model_feats, keep=["party_id"])
    return rounded(reshape.melt(aligned, ["party_id"], model_feats, "feature", "value"))
