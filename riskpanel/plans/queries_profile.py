"""Registered profiling, quality, cleaning, banding and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions import binning as B
from riskpanel.operators import cleaning, encoding, evaluate, profile, quality, store
from riskpanel.plans import proxy
from riskpanel.plans import sqlparts as S
from riskpanel.plans.registry import register, rounded

POP = ["party_id", "startdate", "fold", "plan", "state", "zip", "gender", "marketing_channel",
       "tobacco_usage_ind", "claims_3mos", "claims_6mos", "claims_12mos", "a_to_e_value"]
POP_NUMERIC = ["party_id", "fold", "claims_3mos", "claims_6mos", "claims_12mos", "a_to_e_value"]
DIMENSIONS = ["plan", "state", "zip", "gender", "marketing_channel", "tobacco_usage_ind", "startdate",
              "claims_12mos"]
SCORES = ["y_test", "y_prior", "y_blend"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ profile


@register("state_means", "A2 T14", sql=f"""
WITH {S.population()}
SELECT state, round(avg(a_to_e_value), 6) AS a_to_e_value FROM pop WHERE state IS NOT NULL GROUP BY state
""")
def state_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 / T14 choropleth table: mean A/E per state."""
    return rounded(profile.state_means(proxy.policies(spark, sf_dir), "state", "a_to_e_value"))


@register("dimension_stats", "A3", sql=f"""
WITH {S.population()}
""" + _union([f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, count(a_to_e_value) AS n, "
              f"round(avg(a_to_e_value), 6) AS mean FROM pop WHERE {d} IS NOT NULL GROUP BY {d}"
              for d in DIMENSIONS]))
def dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: count and mean A/E per level of eight dimensions, one GROUPING SETS scan."""
    return rounded(profile.by_dimension(proxy.policies(spark, sf_dir), DIMENSIONS, "a_to_e_value"))


@register("describe_events", "A5", sql="""
SELECT event_type, 'value' AS column, count(value) AS count, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max
FROM events GROUP BY event_type
""")
def describe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: describe() of event values per event type (exact interpolated quartiles)."""
    ev = proxy.table(spark, sf_dir, "events")
    return rounded(profile.describe(ev, ["value"], by=["event_type"]))


@register("describe_scores", "A5", sql=f"""
WITH {S.pairs()}
""" + _union([f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, "
              f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
              f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
              f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM pairs" for c in SCORES]))
def describe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 on truth and the two scores."""
    return rounded(profile.describe(proxy.scored_table(spark, sf_dir), SCORES))


@register("value_counts", "A7 W3", sql=f"""
WITH {S.population()},
c AS (SELECT marketing_channel, count(*) AS count FROM pop WHERE marketing_channel IS NOT NULL GROUP BY 1)
SELECT marketing_channel, count, round(count / sum(count) OVER () * 100.0, 6) AS percentage FROM c
""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and percentages of a category, NULL excluded."""
    return rounded(profile.value_counts(proxy.policies(spark, sf_dir), "marketing_channel"))


@register("prevalence_by_state", "A10", sql=f"""
WITH {S.panel_long()}
SELECT state, feature AS column,
       round(avg(CASE WHEN value IS NULL OR value <> 0 THEN 1 ELSE 0 END) * 100.0, 6) AS pct_non_zero
FROM panel_long GROUP BY state, feature
""")
def prevalence_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: percent non-zero of every claim feature per state (NULL counts as non-zero)."""
    return rounded(store.prevalence(proxy.panel_profile(spark, sf_dir, "state"), ["state"]))


@register("prevalence_overall", "A10", sql=f"""
WITH {S.panel_long()}
SELECT feature AS column, round(avg(CASE WHEN value IS NULL OR value <> 0 THEN 1 ELSE 0 END) * 100.0, 6) AS pct_non_zero
FROM panel_long GROUP BY feature
""")
def prevalence_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 without groups: percent non-zero of every claim feature."""
    return rounded(store.prevalence(proxy.panel_profile(spark, sf_dir)))


@register("flag_means", "A13 C13", sql=f"""
WITH {S.population()}
SELECT CASE WHEN a_to_e_value >= 10 THEN 1 ELSE 0 END AS high_ae,
       round(avg(claims_3mos), 6) AS claims_3mos, round(avg(claims_6mos), 6) AS claims_6mos,
       round(avg(claims_12mos), 6) AS claims_12mos
FROM pop GROUP BY 1
""")
def flag_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim-count means for A/E >= 10 versus the rest."""
    return rounded(profile.flag_means(proxy.policies(spark, sf_dir), "a_to_e_value", ">=", 10,
                                      ["claims_3mos", "claims_6mos", "claims_12mos"], "high_ae"))


@register("histogram_prior", "T11", sql=f"""
WITH {S.pairs()},
rng AS (SELECT min(y_prior) AS lo, max(y_prior) AS hi FROM pairs),
e AS (SELECT i, CASE WHEN i = 1000 THEN hi ELSE i::DOUBLE * ((hi - lo) / 1000.0::DOUBLE) + lo END AS edge
      FROM range(1001) r(i), rng),
b AS (SELECT (SELECT count(*) FROM e WHERE e.edge <= p.y_prior) AS k FROM pairs p),
c AS (SELECT least(k - 1, 999) AS bin, count(*) AS cnt FROM b GROUP BY 1)
SELECT CAST(e.i AS INTEGER) AS bin, round(e.edge, 6) AS lo, round(e2.edge, 6) AS hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM e JOIN e e2 ON e2.i = e.i + 1 LEFT JOIN c ON c.bin = e.i
""")
def histogram_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 equal-width bins of the prior-year score."""
    return rounded(profile.histogram(proxy.scored_table(spark, sf_dir), "y_prior", 1000))


@register("density_prior", "T12", sql=f"""
WITH {S.pairs()},
st AS (SELECT count(y_prior) AS n, stddev_samp(y_prior) * pow(count(y_prior)::DOUBLE, -0.2) AS bw,
              min(y_prior) AS lo, max(y_prior) AS hi FROM pairs WHERE y_prior IS NOT NULL),
g AS (SELECT CAST(i AS INTEGER) AS i,
             CASE WHEN i = 199 THEN hi + 3.0 * bw
                  ELSE i::DOUBLE * (((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199.0) + (lo - 3.0 * bw) END AS x,
             n, bw
      FROM range(200) r(i), st)
SELECT g.i, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * ((g.x - p.y_prior) / g.bw) * ((g.x - p.y_prior) / g.bw)))
             / (g.n * g.bw * sqrt(2 * pi())), 6) AS density
FROM g, pairs p WHERE p.y_prior IS NOT NULL GROUP BY g.i, g.x, g.n, g.bw
""")
def density_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian KDE (Scott's bandwidth) of the prior-year score on a 200-point grid."""
    return rounded(profile.density(proxy.scored_table(spark, sf_dir), "y_prior"))


@register("histogram_auto", "T11", sql=f"""
WITH {S.pairs()},
st AS (SELECT count(y_prior) AS n, min(y_prior) AS lo, max(y_prior) AS hi,
              quantile_cont(y_prior, 0.75) - quantile_cont(y_prior, 0.25) AS iqr FROM pairs),
m AS (SELECT lo, hi, CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), greatest(2 * iqr / pow(n, 1.0 / 3), (hi - lo) / sqrt(n) / 2))) AS BIGINT) AS bins FROM st),
e AS (SELECT i, CASE WHEN i = bins THEN hi ELSE i::DOUBLE * ((hi - lo) / bins::DOUBLE) + lo END AS edge, bins
      FROM m, LATERAL (SELECT unnest(range(m.bins + 1)) AS i)),
b AS (SELECT (SELECT count(*) FROM e WHERE e.edge <= p.y_prior) AS k FROM pairs p WHERE y_prior IS NOT NULL),
c AS (SELECT least(k - 1, (SELECT bins - 1 FROM m)) AS bin, count(*) AS cnt FROM b GROUP BY 1)
SELECT CAST(e.i AS INTEGER) AS bin, round(e.edge, 6) AS lo, round(e2.edge, 6) AS hi, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM e JOIN e e2 ON e2.i = e.i + 1 LEFT JOIN c ON c.bin = e.i
""")
def histogram_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the prior-year score with as many bins as its quartiles and count ask for."""
    return rounded(profile.histogram(proxy.scored_table(spark, sf_dir), "y_prior", "auto"))


@register("density_binned_prior", "T12", sql=f"""
WITH {S.pairs()},
st AS (SELECT count(y_prior) AS n, stddev_samp(y_prior) * pow(count(y_prior)::DOUBLE, -0.2) AS bw,
              min(y_prior) AS lo, max(y_prior) AS hi, (max(y_prior) - min(y_prior)) / 4095.0::DOUBLE AS step FROM pairs),
a AS (SELECT (y_prior - lo) / step AS z, least(floor((y_prior - lo) / step), 4094) AS b FROM pairs, st WHERE y_prior IS NOT NULL),
w AS (SELECT b, sum(w) AS w FROM (SELECT b, b + 1 - z AS w FROM a UNION ALL SELECT b + 1, z - b FROM a) GROUP BY b),
g AS (SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 199 THEN hi + 3.0 * bw
                  ELSE i::DOUBLE * (((hi + 3.0 * bw) - (lo - 3.0 * bw)) / 199.0) + (lo - 3.0 * bw) END AS x FROM range(200) r(i), st)
SELECT i, round(x, 6) AS x, round(sum(w * exp(-0.5 * pow((x - (b * step + lo)) / bw, 2))) / (max(n) * max(bw) * sqrt(2 * pi())), 6) AS density
FROM g, w, st GROUP BY i, x
""")
def density_binned_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density of the prior-year score from 4,096 linear bins, whatever the rows."""
    return rounded(profile.binned_density(proxy.scored_table(spark, sf_dir), "y_prior"))


# ------------------------------------------------------------------ quality


@register("missing_report", "A8", sql=f"""
WITH {S.population()}
""" + _union([f"SELECT '{c}' AS column, CAST(count(*) - count({c}) AS BIGINT) AS missing, "
              f"round((count(*) - count({c})) / count(*) * 100.0, 6) AS missing_pct FROM pop" for c in POP]))
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL count and percent per column of the member table."""
    return rounded(quality.missing(proxy.policies(spark, sf_dir)))


@register("all_missing_features", "A9", sql=f"""
WITH {S.panel_long()}
SELECT feature AS column FROM panel_long GROUP BY feature HAVING count(nullif(value, 0)) = 0
""")
def all_missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim features with no recorded value (NULL or 0) in any fold."""
    return store.all_missing(proxy.panel_profile(spark, sf_dir, "fold"))


@register("panel_info", "A15", sql=f"""
WITH {S.population()}
""" + _union([f"SELECT '{c}' AS column, {S.SPARK_TYPE.format(t=f'first(typeof({c}))')} AS dtype, "
              f"count({c}) AS non_null, count(*) AS rows FROM pop" for c in POP]))
def panel_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column types, non-null counts and row count."""
    return quality.info(proxy.policies(spark, sf_dir))


def _narrow_sql(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    rng = " ".join(f"WHEN min({x}) >= {lo}::DOUBLE AND max({x}) <= {hi}::DOUBLE THEN '{n}'"
                   for n, lo, hi in [("tinyint", -128, 127), ("smallint", -32768, 32767),
                                     ("int", -2147483648, 2147483647)])
    dt = S.SPARK_TYPE.format(t=f"first(typeof({c}))")
    return (f"SELECT '{c}' AS column, {dt} AS dtype, CASE WHEN sum(CASE WHEN {c} IS NULL OR isnan({x}) THEN 1 "
            f"ELSE 0 END) = 0 AND sum(CASE WHEN {x} <> floor({x}) THEN 1 ELSE 0 END) = 0 THEN CASE {rng} "
            f"ELSE (CASE WHEN {dt} IN ('tinyint','smallint','int','bigint') THEN 'bigint' ELSE {dt} END) END "
            f"ELSE {dt} END AS narrow_type FROM pop")


@register("narrow_types", "C3", sql=f"WITH {S.population()}\n" + _union([_narrow_sql(c) for c in POP_NUMERIC]))
def narrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrowest lossless integer type per numeric column."""
    return quality.narrow_types(proxy.policies(spark, sf_dir), POP_NUMERIC)


def _txt(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), 'None')"


@register("cleaned_fold", "C1 C2 C4 C5 C6 F1 P2", sql=f"""
WITH {S.population()},
src AS (SELECT *, nullif(marketing_channel, '5-LOW') AS mc,
               CASE WHEN tobacco_usage_ind IN ('F', 'O') THEN tobacco_usage_ind ELSE 'unknown' END AS tu
        FROM pop WHERE plan IN {S.in_list(proxy.KEPT_PLANS)})
SELECT party_id, fold, {_txt("plan")} AS plan, {_txt("state")} AS state, {_txt("gender")} AS gender,
       {_txt("mc")} AS marketing_channel, {_txt("tu")} AS tobacco_usage_ind,
       coalesce(claims_3mos, 0) AS claims_3mos, coalesce(claims_6mos, 0) AS claims_6mos,
       coalesce(claims_12mos, 0) AS claims_12mos, round(coalesce(a_to_e_value, 0.0), 6) AS a_to_e_value
FROM src
""")
def cleaned_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3 clean-up: sentinel -> NULL, whitelist, plan filter, drop columns,
    text to categories ('None' for missing), numerics filled with 0."""
    pol = proxy.policies(spark, sf_dir)
    pol = cleaning.null_sentinel(pol, "marketing_channel", "5-LOW")
    pol = cleaning.whitelist(pol, "tobacco_usage_ind", ["F", "O"])
    return rounded(cleaning.clean_fold(pol, proxy.KEPT_PLANS, drop=["zip", "startdate"]))


# ------------------------------------------------------------------ banding


@register("zip_band_map", "B1 B4 P10", sql=f"""
WITH {S.population()}
SELECT zip, round(avg(a_to_e_value), 6) AS mean,
       {S.band_case("avg(a_to_e_value)", B.BAND8_EDGES, B.BAND8_LABELS)} AS category
FROM pop WHERE zip IS NOT NULL GROUP BY zip
""")
def zip_band_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zip -> band of its mean A/E (8-level band)."""
    return rounded(encoding.encode_by_mean(proxy.policies(spark, sf_dir), "zip", "a_to_e_value"))


def _band_report_sql(expr_sql: str) -> str:
    return f"""
WITH {S.pairs()}
SELECT {expr_sql} AS ae_group, count(*) AS n, round(avg(y_test), 6) AS mean_y_test,
       round(avg(y_prior), 6) AS mean_y_prior, round(avg(y_blend), 6) AS mean_y_blend
FROM pairs GROUP BY 1"""


@register("band_report_13", "B2 A4", sql=_band_report_sql(
    S.band_case("y_test", B.BAND13_EDGES[:12], B.BAND13_LABELS)))
def band_report_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over the 13-level A/E group: size and mean of truth and scores."""
    p = proxy.score_pairs(spark, sf_dir).withColumn("ae_group", B.band13("y_test"))
    return rounded(evaluate.band_report(p, "ae_group", SCORES))


@register("band_report_step", "B3 A4", sql=_band_report_sql(
    S.band_case("y_test", B.step_edges(), B.step_labels(B.step_edges()), lower_open=False)))
def band_report_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over 0.1-step bands (negatives, >= 2 and NULL in '2.0+')."""
    p = proxy.score_pairs(spark, sf_dir).withColumn("ae_group", B.band_step("y_test"))
    return rounded(evaluate.band_report(p, "ae_group", SCORES))


# --------------------------------------------------------------- evaluation


@register("regression_metrics", "T10 C11", sql=f"""
WITH {S.pairs()}
""" + _union([f"SELECT '{p}' AS model, count(*) AS n, round(avg(({p} - y_test) * ({p} - y_test)), 6) AS mse, "
              f"round(sqrt(avg(({p} - y_test) * ({p} - y_test))), 6) AS rmse, "
              f"round(1 - avg(({p} - y_test) * ({p} - y_test)) / var_pop(y_test), 6) AS r2, "
              f"round(avg({p} - y_test), 6) AS mean_error FROM pairs WHERE {p} - y_test IS NOT NULL"
              for p in ["y_prior", "y_blend"]]))
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R², MSE, RMSE and mean error of both scores."""
    return rounded(evaluate.regression_metrics(proxy.score_pairs(spark, sf_dir), "y_test", ["y_prior", "y_blend"]))


@register("score_corr_matrix", "T5", sql=f"""
WITH {S.pairs()}
""" + _union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM pairs"
              for a in SCORES for b in SCORES]))
def score_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: correlation matrix of truth and scores in one aggregate."""
    return rounded(evaluate.corr_matrix(proxy.score_pairs(spark, sf_dir), SCORES))


@register("mean_comparison", "A14", sql=f"""
WITH {S.pairs()}
""" + _union([f"SELECT '{c}' AS series, round(avg({c}), 6) AS mean FROM pairs" for c in SCORES]))
def mean_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall mean of truth versus each score."""
    return rounded(evaluate.mean_comparison(proxy.score_pairs(spark, sf_dir), SCORES))


@register("legacy_join", "J3 J4", sql=f"""
WITH {S.pairs()},
legacy AS (SELECT c_custkey AS legacy_party_id, (c_acctbal + 1000.0) / 5000.0 AS legacy_score FROM customer)
SELECT p.party_id, p.startdate, round(p.y_test, 6) AS y_test, l.legacy_party_id, round(l.legacy_score, 6) AS legacy_score
FROM pairs p JOIN legacy l ON p.party_id = l.legacy_party_id
""")
def legacy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows joined to a legacy score table keyed by a differently named column."""
    legacy = proxy.legacy_scores(spark, sf_dir)
    p = proxy.score_pairs(spark, sf_dir).select("party_id", "startdate", "y_test")
    return rounded(evaluate.join_scores(p, legacy, "party_id", "legacy_party_id"))
