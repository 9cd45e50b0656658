"""Cases that were wrong or failed once: results must not depend on plan rewrites, levels may hold any
text, empty tables and empty cells have a result, and nothing is capped."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.ml import models
from riskpanel.operators import evaluate, fairness, profile, quality, quantiles, reshape, selection
from riskpanel.plans import proxy
from riskpanel.sources import lookups, readers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("reuse, adaptive", itertools.product(["true", "false"], repeat=2))
def test_quantiles_do_not_depend_on_plan_rewrites(spark, reuse, adaptive):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in np.round(rng.normal(50, 20, 700), 1)] + [("a", 7.0)] * 400 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    keys = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {r.g: (r.q25, r.q50, r.q99) for r in quantiles.exact_quantiles(df, "v", [0.25, 0.5, 0.99], ["g"]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got.keys() == {"a", "b"}
    for g in got:
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.25, 0.5, 0.99]))


def test_contingency_lists_empty_cells(spark):
    rows = [("x", 0)] * 6 + [("x", 1)] * 4 + [("y", 0)] * 5
    df = spark.createDataFrame(rows, "g string, t int")
    assert {(r.g, r.t): r["count"] for r in fairness.crosstab(df, "g", "t").collect()} == \
        {("x", 0): 6, ("x", 1): 4, ("y", 0): 5, ("y", 1): 0}
    e = {(r.g, r.t): (r.observed, r.expected) for r in fairness.expected_counts(df, "g", "t").collect()}
    assert e[("y", 1)] == (0, 5 * 4 / 15)
    chi = fairness.chi_square(df, "g", "t").first()
    assert abs(chi.chi2 - sum((o - x) ** 2 / x for o, x in e.values())) < 1e-12 and chi.dof == 1


def test_correlation_beside_a_large_mean(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "k int, y double")
    long = spark.createDataFrame([(i, "big", 1e7 + float(v)) for i, v in enumerate(y)] + [(i, "same", 0.1) for i in range(200)]
                                 + [(i, "sparse", 1.0) for i in range(0, 200, 3)], "k int, feature string, value double")
    got = {r.feature: r.corr for r in selection.target_corr(long, rows, ["k"], "y", ["big", "same", "sparse", "none"]).collect()}
    dense = np.zeros(200)
    dense[::3] = 1
    assert abs(got["big"] - 1) < 1e-9 and got["same"] is None and got["none"] is None
    assert abs(got["sparse"] - np.corrcoef(dense, y)[0, 1]) < 1e-12


def test_levels_may_hold_any_text(spark):
    levels = ["St. Louis", "a", "A", "it's", "b`c", None, "\\", ""]
    rows = [(float(i % 7), levels[i % len(levels)], float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, t string, y double")
    model = models.fit_pipeline(df, ["x"], ["t"], models.lasso(0.001, label="y"), "y")
    names = [n for n, _ in models.coefficients(model)]
    assert names == ["num__x", *[f"cat__t_{v}" for v in sorted(v for v in levels if v is not None)[1:]]]
    x = {r.t: r.features.toArray().tolist()[1:] for r in model.transform(df).select("t", "features").collect()}
    assert x[None] == x[""] == [0.0] * 6 and all(sum(x[v]) == 1.0 for v in levels if v)


def test_twelve_thousand_levels(spark):
    df = spark.range(24_000).select((F.col("id") % 12_000).cast("string").alias("t"), (F.col("id") % 2).cast("double").alias("y"))
    prep = models.fit_preprocessor(df, [], ["t"])
    assert len(prep.feature_names) == 11_999
    assert prep.transform(df).select("features").first()[0].size == 11_999


def test_coefficient_comparison_keeps_every_row(spark):
    a = spark.range(15_000).select(F.col("id").cast("string").alias("feature"), F.lit(1.0).alias("coef_a"))
    b = spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("feature"), F.lit(2.0).alias("coef_b"))
    assert fairness.compare_coefficients(a, b, k=None).count() == 20_000
    assert fairness.compare_coefficients(a, b, k=30).count() == 30


def test_unsupported_depth_is_refused():
    with pytest.raises(ValueError):
        models.boosted({"max_depth": 31})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert {r.missing_pct for r in quality.missing(none).collect()} == {None}
    assert {r.accept_pct for r in evaluate.threshold_curve(none, ["v"], "v").collect()} == {None}
    assert profile.histogram(none, "v").count() == 0 and profile.density(none, "v").count() == 0
    assert profile.value_counts(none, "g").count() == 0
    assert quantiles.exact_quantiles(none, "v", [0.5]).count() == 0
    assert fairness.crosstab(none, "g", "v").count() == 0
    assert profile.describe(none, ["v"], ["g"]).count() == 0


def test_transpose_takes_a_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, x double")
    assert reshape.transpose(df, "k").collect()[0].asDict() == {"column": "x", "NULL": 2.0, "a": 1.0}


def test_sample_share_is_of_all_rows(spark):
    df = spark.range(1000).withColumn("w", (F.col("id") % 2).cast("double"))
    got = reshape.weighted_sample(df, frac=0.2, weight="w", seed=1).collect()
    assert len(got) == 200 and len({r.id for r in got}) == 200 and all(r.w > 0 for r in got)


def test_mapping_object_keeps_all_keys(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"A1": "x",\n "a1": "y",\n "b.c": 3}')
    assert {(r.key, r.value) for r in lookups.load_map(spark, str(tmp_path / "m.json")).collect()} == \
        {("A1", "x"), ("a1", "y"), ("b.c", "3")}


def test_partitioned_read_needs_bounds(spark):
    with pytest.raises(ValueError):
        readers.read_query(spark, "select 1", url="jdbc:none", partition_column="id")


def test_dates_reach_the_scan(spark):
    lines = proxy.claim_lines(spark, SF, proxy.window_bounds(["1996-01-01"], 12, back=False))
    text = lines._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_checkpoint_folder_is_needed_on_a_cluster(monkeypatch):
    from riskpanel import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_cross_corr_covers_every_fold(spark):
    from riskpanel.plans import proxy, queries_select
    got = [r.asDict() for r in queries_select.cross_corr_folds(spark, "/root/testdata/sf0.001").collect()]
    assert {r["fold"] for r in got} == set(range(1, len(proxy.START_DATES) + 1))
    last = [{k: v for k, v in r.items() if k != "fold"} for r in got if r["fold"] == len(proxy.START_DATES)]
    want = [r.asDict() for r in queries_select.cross_corr(spark, "/root/testdata/sf0.001").collect()]
    by_rank = lambda rows: sorted((r["feature"], r["rank"], r["other"], r["corr"]) for r in rows)
    assert by_rank(last) == by_rank(want)
