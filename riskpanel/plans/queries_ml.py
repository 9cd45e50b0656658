"""Registered validation, tuning and model queries."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.ml import boosted_search as boosted_search_ml
from riskpanel.ml import models, penalty_path, scoring, sparse, tuning
from riskpanel.operators import cleaning, evaluate, fairness, panel as panel_ops
from riskpanel.plans import proxy
from riskpanel.plans import sqlparts as S
from riskpanel.plans.registry import register, rounded
from riskpanel.session import checkpoint_dir, materialize
from riskpanel.sources import sinks

FOLDS = [1, 2, 3, 4, 5]
WEIGHTS = [i / 10 for i in range(11)]
SLIDING = tuning.sliding_splits(FOLDS, train_span=1, holdout=1)
EXPANDING = tuning.expanding_splits(FOLDS, holdout=1)
TEXT = ["plan", "gender", "marketing_channel", "tobacco_usage_ind"]


def _split_values(splits) -> str:
    rows = []
    for s, (train, test) in enumerate(splits, start=1):
        rows += [f"({s}, {f}, 'train')" for f in train] + [f"({s}, {test}, 'test')"]
    return "(VALUES " + ", ".join(rows) + ") v(split, fold, role)"


def _trials_sql(tail: str) -> str:
    metric_cols = ",\n  ".join(
        f"round(max(CASE WHEN split = {s} AND role = '{r}' THEN {m} END), 6) AS user_attrs_sw{s}_{r}_{m}"
        for s in range(1, len(SLIDING) + 1) for r in ("train", "test") for m in ("mse", "rmse", "r2"))
    avgs = ",\n  ".join(f"round(avg(CASE WHEN role = '{r}' THEN {m} END), 6) AS average_{r}_{m}"
                        for r in ("train", "test") for m in ("rmse", "r2"))
    return f"""
WITH {S.pairs()},
splits AS (SELECT * FROM {_split_values(SLIDING)}),
tagged AS (SELECT s.split, s.role, p.plan AS g, p.y_test AS y, p.y_prior AS p FROM pairs p JOIN splits s ON p.fold = s.fold),
means AS (SELECT split, g, avg(y) AS m FROM tagged WHERE role = 'train' GROUP BY ALL),
grid AS (SELECT CAST(i AS INTEGER) AS number, i::DOUBLE / 10.0::DOUBLE AS w FROM range({len(WEIGHTS)}) r(i)),
ev AS (SELECT t.split, t.role, g.number, g.w, g.w * t.p + (1 - g.w) * m.m - t.y AS e, t.y
       FROM tagged t JOIN means m ON m.split = t.split AND m.g = t.g CROSS JOIN grid g),
met AS (SELECT number, w, split, role, avg(e * e) AS mse, var_pop(y) AS v FROM ev GROUP BY ALL),
lng AS (SELECT number, w, split, role, mse, sqrt(mse) AS rmse, 1 - mse / v AS r2 FROM met),
trials AS (
SELECT number, round(avg(CASE WHEN role = 'test' THEN rmse END), 6) AS value, round(w, 6) AS params_w,
  {metric_cols},
  {avgs}
FROM lng GROUP BY number, w)
{tail}"""


def _blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = proxy.score_pairs(spark, sf_dir)
    return tuning.blend_trials(pairs, "y_test", "y_prior", "plan", "fold", SLIDING, WEIGHTS)


@register("blend_trials", "V1 V3 V4 P14 T14", sql=_trials_sql("SELECT * FROM trials"))
def blend_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1/V4: sliding temporal validation of the credibility blend
    ``w * prior A/E + (1 - w) * plan mean`` over 11 weights: the trials table
    with per-window train/test MSE, RMSE, R² and their averages."""
    return rounded(_blend(spark, sf_dir))


@register("best_blend_trial", "O4", sql=_trials_sql("SELECT * FROM trials ORDER BY value LIMIT 1"))
def best_blend_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial with the lowest mean test RMSE."""
    return rounded(tuning.best_trial(_blend(spark, sf_dir), integer_params=["number"]))


@register("expanding_membership", "V2", sql=f"""
WITH {S.pairs()},
splits AS (SELECT * FROM {_split_values(EXPANDING)})
SELECT CAST(s.split AS INTEGER) AS split, s.role, count(*) AS n_rows,
       CAST(min(p.fold) AS INTEGER) AS min_fold, CAST(max(p.fold) AS INTEGER) AS max_fold
FROM pairs p JOIN splits s ON p.fold = s.fold GROUP BY s.split, s.role
""")
def expanding_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: rows and fold range of each expanding split (no test fold before its training folds)."""
    mem = tuning.split_membership(spark, EXPANDING)
    pairs = proxy.score_pairs(spark, sf_dir).select("fold")
    j = pairs.join(F.broadcast(mem), "fold")
    return j.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n_rows"), F.min("fold").alias("min_fold"),
                                          F.max("fold").alias("max_fold"))


KEYS, CLAIMS, LABEL = ["party_id", "startdate"], [f"claims_{m}mos" for m in proxy.WINDOWS], "a_to_e_value"


def _store(spark: SparkSession, sf_dir: str):
    """The claims store, the code domains, the rows of the kept plans and the features of the code table."""
    domains = proxy.code_domains(spark, sf_dir)
    store = proxy.member_store(spark, sf_dir, proxy.START_DATES, domains)
    rows = proxy.outcome_rows(spark, sf_dir, store, proxy.START_DATES)
    rows = rows.join(proxy.order_indicators(spark, sf_dir), KEYS, "left").select(*KEYS, "fold", LABEL, *TEXT, *CLAIMS)
    rows = materialize(cleaning.clean_fold(rows, proxy.KEPT_PLANS), "training_rows")
    known = spark.createDataFrame([(n, None) for n in [*CLAIMS, *proxy.feature_names(domains)]], "column string, level string")
    return store, domains, rows, known


def _index(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The feature index: the store's names are all in ``known``, so only the rows' own cells are searched for levels."""
    return materialize(sparse.feature_index(sparse.row_cells(rows, KEYS, CLAIMS, TEXT), known), "feature_index")


def _row_vectors(rows: DataFrame, store: DataFrame, domains: dict, index: DataFrame, kept: list[str]) -> DataFrame:
    return sparse.item_vectors(rows, store.select(*KEYS, "items"), proxy.item_names(domains), index, KEYS, CLAIMS, TEXT, kept)


def _vectors(spark: SparkSession, sf_dir: str):
    """The training rows as sparse vectors, written once, and their feature index."""
    store, domains, rows, known = _store(spark, sf_dir)
    index = _index(rows, known)
    return _row_vectors(rows, store, domains, index, ["fold", LABEL]), index


@register("training_cells", "M1", sql=f"""
WITH {S.panel_long()},
kept AS (SELECT * FROM pop WHERE plan IN {S.in_list(proxy.KEPT_PLANS)}),
cells AS (
  SELECT p.party_id, p.startdate, p.fold, p.feature AS col, NULL AS level, p.value FROM panel_long p JOIN kept USING (party_id, startdate) WHERE p.value <> 0
  UNION ALL SELECT party_id, startdate, fold, c.col, NULL, c.v FROM kept, (VALUES ('claims_3mos'), ('claims_6mos'), ('claims_12mos')) n(col),
    LATERAL (SELECT n.col, CASE n.col WHEN 'claims_3mos' THEN claims_3mos WHEN 'claims_6mos' THEN claims_6mos ELSE claims_12mos END AS v) c WHERE c.v <> 0
  UNION ALL SELECT party_id, startdate, fold, n.col, coalesce(trim(CASE n.col WHEN 'plan' THEN plan WHEN 'gender' THEN gender
    WHEN 'marketing_channel' THEN marketing_channel ELSE tobacco_usage_ind END), 'None'), 1.0
    FROM kept, (VALUES ('plan'), ('gender'), ('marketing_channel'), ('tobacco_usage_ind')) n(col)),
names AS (SELECT col, level FROM cells UNION SELECT DISTINCT feature, NULL FROM panel_long
  UNION SELECT unnest(['claims_3mos', 'claims_6mos', 'claims_12mos']), NULL),
idx AS (SELECT col, level, CAST(row_number() OVER (ORDER BY level IS NOT NULL, col, level) - 1 AS INTEGER) AS index FROM names),
n AS (SELECT count(*) AS n FROM kept WHERE fold <= 4),
tr AS (SELECT col, level, count(*) AS k, sum(value) AS s, sum(value * value) AS ss FROM cells WHERE fold <= 4 GROUP BY ALL)
SELECT index, CASE WHEN idx.level IS NULL THEN 'num__' || idx.col ELSE 'cat__' || idx.col || '_' || idx.level END AS feature,
  coalesce(k, 0) AS non_zero, round(coalesce(s, 0) / n, 6) AS mean, round(sqrt(coalesce(ss, 0) / n - pow(coalesce(s, 0) / n, 2)), 6) AS std
FROM idx LEFT JOIN tr ON tr.col = idx.col AND tr.level IS NOT DISTINCT FROM idx.level CROSS JOIN n
""")
def training_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the distributed feature index and, read back from the sparse training vectors of folds 1-4, each
    feature's non-zero rows, mean and population std."""
    rows, index = _vectors(spark, sf_dir)
    entries = rows.where("fold <= 4").select(F.unwrap_udt("vector").alias("v")).select(
        F.explode(F.arrays_zip("v.indices", "v.values")).alias("e")).select(F.col("e.indices").alias("index"), F.col("e.values").alias("x"))
    sums = entries.groupBy("index").agg(F.count("*").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n = F.lit(rows.where("fold <= 4").count())
    k, m = F.coalesce("k", F.lit(0)), F.coalesce("m", F.lit(0.0))
    spread = (k * F.coalesce("v", F.lit(0.0)) + m * m * k * (n - k) / n) / n  # the zeros joined to the others
    name = F.when(F.col("level").isNull(), F.concat(F.lit("num__"), "column")).otherwise(F.concat(F.lit("cat__"), "column", F.lit("_"), "level"))
    return rounded(index.join(sums, "index", "left").select(
        "index", name.alias("feature"), k.alias("non_zero"), (m * k / n).alias("mean"), F.sqrt(spread).alias("std")))


@register("lasso_coefficients", "M1 M2 V5")
def lasso_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2: scaled numerics and one-hot text, Lasso (alpha 0.01) refit on
    folds 1-4; the coefficient table plus the intercept."""
    rows, index = _vectors(spark, sf_dir)
    model = tuning.refit(rows, "fold", FOLDS[:-1], lambda tr: sparse.fit(tr, index, models.lasso(0.01, label=LABEL)))
    coefs = models.coefficients(model) + [("intercept", float(model.stages[-1].intercept))]
    return spark.createDataFrame(coefs, "feature string, coef double")


@register("boosted_holdout", "M3 T10")
def boosted_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: boosted trees on folds 1-4, scored on the held-out fold 5."""
    rows, index = _vectors(spark, sf_dir)
    est = models.boosted({"max_depth": 4, "learning_rate": 0.1, "n_estimators": 100, "bagging_fraction": 0.8,
                          "min_data_in_leaf": 20}, label=LABEL)
    model = sparse.fit(rows.where("fold <= 4"), index, est)
    scored = model.transform(rows.where("fold = 5")).select(LABEL, "prediction")
    return evaluate.regression_metrics(scored, LABEL, ["prediction"])


@register("calibration_legacy", "M4 J3")
def calibration_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: legacy score calibrated to A/E in-sample (boosted trees)."""
    legacy = proxy.legacy_scores(spark, sf_dir)
    p = proxy.score_pairs(spark, sf_dir).select("party_id", "startdate", "y_test")
    j = evaluate.join_scores(p, legacy, "party_id", "legacy_party_id")
    model = models.calibrator(label="y_test", feature="legacy_score").fit(j)
    return model.transform(j).select("party_id", "startdate", "legacy_score", "y_test", "calibrated")


@register("batch_score", "M5 P8 P9 K5")
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: a fitted pipeline saved to the shared checkpoint folder, loaded back
    and applied to the aligned held-out batch; predictions stay on their rows."""
    store, domains, rows, known = _store(spark, sf_dir)
    index = _index(rows, known)
    # fold 5 comes as cells of its own: it is aligned with the saved index, not with the training rows' vectors
    train = _row_vectors(rows.where("fold <= 4"), store, domains, index, ["fold", LABEL])
    model = sparse.fit(train, index, models.lasso(0.01, label=LABEL))
    path = os.path.join(checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    sinks.save_model(model, f"{path}/model")
    sparse.save_index(index, f"{path}/index")
    loaded = sinks.load_model(f"{path}/model")
    batch = _row_vectors(rows.where("fold = 5"), store, domains, sparse.load_index(spark, f"{path}/index"), [])
    return scoring.score(loaded, batch, keep=["party_id"])


#: V3 and V6: columns, text columns, range of the penalty, trials and splits of the two Lasso searches; as in
#: the reference, the first leaves gender out and ends before fold 5, the second slides over all folds.
CODES = ("ccs_", "ccsr_", "drg_")
SEARCHES = {
    "all": (("",), [c for c in TEXT if c != "gender"], (0.001, 0.3), 20, SLIDING),
    "codes": (CODES, [], (0.01, 1.0), 25, tuning.sliding_splits(FOLDS, train_span=1, holdout=0)),
}


@register("tuning_search", "V3 V5 V6")
def tuning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3/V6: seeded random searches of the Lasso penalty over all features and over the claims-code columns,
    each trial fitted and scored on the sliding splits. V5: each search's best penalty retrained on every pair of consecutive
    folds (``stage`` retrain) and fitted on all folds (final).

    The rows are read once: cross products of the folds hold all that the trials need.
    """
    data, index = _vectors(spark, sf_dir)
    retrain = tuning.sliding_splits(FOLDS, train_span=1, holdout=0)
    shift = penalty_path.shifts(data, LABEL)
    products = materialize(penalty_path.fold_products(data, "fold", LABEL, shift), "products")
    numeric = [r["column"] for r in index.where("level is null").select("column").collect()]  # the models' own names
    out = []
    for name, (prefixes, text, (low, high), n_trials, splits) in SEARCHES.items():
        columns = [c for c in numeric if c.startswith(prefixes)]
        drawn = [p["alpha"] for p in tuning.draws({"alpha": ("loguniform", low, high)}, n_trials, seed=42)]
        errors = materialize(penalty_path.fit_paths(products, index, shift, columns, text, splits, drawn), "trials")
        trials = tuning.trials_table(errors, len(retrain), ["alpha"]).withColumn("stage", F.lit("trial"))
        best = tuning.best_trial(trials, F.struct("value", "number")).select("number", "params_alpha").first()
        again = penalty_path.fit_paths(products, index, shift, columns, text, retrain, [best.params_alpha])
        again = tuning.trials_table(again, len(retrain), ["alpha"]).withColumn("stage", F.lit("retrain"))
        final, _ = penalty_path.fit_folds(products, index, shift, columns, text, FOLDS, [best.params_alpha])
        final = final.select(F.lit("final").alias("stage"), F.col("alpha").alias("params_alpha"),
                             *[F.col(m).alias(f"final_{m}") for m in tuning.METRICS])
        chosen = again.unionByName(final, allowMissingColumns=True).withColumn("number", F.lit(best.number))
        out.append(trials.unionByName(chosen, allowMissingColumns=True).withColumn("search", F.lit(name)))
    return out[0].unionByName(out[1]).select("search", "stage", "number", *[c for c in out[0].columns if c not in ("search", "stage", "number")])


@register("boosted_search", "V3 V5 M3 K5")
def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3/M3: 30 random trials of boosted trees over the sliding windows (``stage`` trial), on features binned once, each with up to the
    reference's 10,000 trees a window. V5 + K5: the best one refitted on folds 1-4, saved, loaded and scored on the fold after them (final)."""
    store, domains, rows, known = _store(spark, sf_dir)
    index = _index(rows, known)
    long = proxy.store_long(store, domains).where(F.col("feature") != "__actual")
    cells = sparse.store_cells(long, KEYS).unionByName(sparse.row_cells(rows, KEYS, CLAIMS, TEXT))
    borders = materialize(boosted_search_ml.feature_borders(cells), "borders")
    data = boosted_search_ml.binned_vectors(_row_vectors(rows, store, domains, index, ["fold", LABEL]), borders, index)
    frames = boosted_search_ml.windows(data, "fold", LABEL, KEYS, SLIDING)
    trials = boosted_search_ml.search(frames, LABEL, 30, parallelism=max(8, spark.sparkContext.defaultParallelism))
    best = min(trials, key=lambda r: (r["value"], r["number"]))
    path = os.path.join(checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    sinks.save_model(PipelineModel(stages=[boosted_search_ml.refit(data.where(F.col("fold") < FOLDS[-1]), best, LABEL)]), path)
    final = tuning.error_metrics(sinks.load_model(path).transform(data.where(F.col("fold") == FOLDS[-1])), LABEL)
    out = [{"stage": "trial", **r} for r in trials] + [
        {"stage": "final", "number": best["number"], **{k: v for k, v in best.items() if k.startswith("params_")}, **{f"final_{m}": v for m, v in final.items()}}]
    kinds = {"stage": "string", "number": "int", "params_max_depth": "int", "params_min_data_in_leaf": "int"} \
        | {f"user_attrs_sw{s}_trees": "int" for s in range(1, len(SLIDING) + 1)}
    cols = [*kinds, *sorted({c for r in out for c in r} - set(kinds))]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in out], ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in cols))


@register("compare_fits", "M7 J5 M2", sql=f"""
WITH {S.population()},
x AS (SELECT fold, n.feature, coalesce(CASE n.feature WHEN 'claims_3mos' THEN claims_3mos WHEN 'claims_6mos' THEN claims_6mos ELSE claims_12mos END, 0)::DOUBLE AS x,
             a_to_e_value AS y FROM pop, (VALUES ('claims_3mos'), ('claims_6mos'), ('claims_12mos')) n(feature) WHERE plan IN {S.in_list(proxy.KEPT_PLANS)}),
s AS (SELECT fold, feature, covar_pop(x, y) / stddev_pop(x) AS c FROM x WHERE fold <= 2 GROUP BY ALL),
w AS (SELECT fold, feature, sign(c) * greatest(abs(c) - 0.01, 0.0) AS coef FROM s)
SELECT 'num__' || feature AS feature, round(a.coef, 6) + 0.0 AS coef_a, round(b.coef, 6) + 0.0 AS coef_b,
       round(abs(a.coef - b.coef), 6) AS coef_diff, a.coef = b.coef AS zero_diff
FROM (SELECT * FROM w WHERE fold = 1) a JOIN (SELECT * FROM w WHERE fold = 2) b USING (feature)
""")
def compare_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 on coefficients of fitted models: one-feature Lasso fits (closed form in the SQL) of folds 1 and 2 side by side."""
    data, index = _vectors(spark, sf_dir)
    shift = penalty_path.shifts(data, LABEL)
    products = materialize(penalty_path.fold_products(data, "fold", LABEL, shift), "products")
    sides = []
    for fold, name in ((1, "coef_a"), (2, "coef_b")):
        own = [penalty_path.fit_folds(products, index, shift, [c], [], [fold], [0.01])[1].where("feature <> 'intercept'") for c in CLAIMS]
        sides.append(panel_ops.stack(own).select("feature", (F.col("coef") + 0.0).alias(name)))
    return rounded(fairness.compare_coefficients(*sides, k=None))


ONE_ALPHAS = [0.001, 0.01, 0.05, 0.2]


@register("lasso_path_one", "M2 V3 V4", sql=f"""
WITH {S.population()},
kept AS (SELECT fold, coalesce(claims_12mos, 0)::DOUBLE AS x, a_to_e_value AS y FROM pop WHERE plan IN {S.in_list(proxy.KEPT_PLANS)}),
splits AS (SELECT * FROM {_split_values(SLIDING)}),
t AS (SELECT split, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS c FROM kept JOIN splits USING (fold) WHERE role = 'train' GROUP BY split),
a AS (SELECT CAST(i - 1 AS INTEGER) AS number, alpha FROM (SELECT unnest({ONE_ALPHAS}::DOUBLE[]) AS alpha, generate_subscripts({ONE_ALPHAS}::DOUBLE[], 1) AS i)),
w AS (SELECT split, number, alpha, mx, my, sign(c) * greatest(abs(c / sx) - alpha, 0.0) / sx AS w FROM t, a),
e AS (SELECT s.split, s.role, w.number, w.alpha, k.y, k.y - w.my - w.w * (k.x - w.mx) AS e FROM kept k JOIN splits s USING (fold) JOIN w USING (split))
SELECT CAST(split AS INTEGER) AS split, role, number, round(alpha, 6) AS alpha, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse,
  round(1 - avg(e * e) / var_pop(y), 6) + 0.0 AS r2 FROM e GROUP BY ALL
""")
def lasso_path_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + V3: the penalty path of one feature on the sliding splits, which has a closed form (soft threshold)."""
    data, index = _vectors(spark, sf_dir)
    shift = penalty_path.shifts(data, LABEL)
    products = penalty_path.fold_products(data, "fold", LABEL, shift)
    errors = rounded(penalty_path.fit_paths(products, index, shift, ["claims_12mos"], [], SLIDING, ONE_ALPHAS).drop("nonzero"))
    return errors.withColumn("r2", F.col("r2") + 0.0)  # no negative zero
