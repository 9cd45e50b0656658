"""Property tests against NumPy / brute force."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskpanel.operators import evaluate, fairness, quantiles, selection

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
finite = st.floats(min_value=-1.0, max_value=3.0, allow_nan=False, allow_infinity=False)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), finite), st.one_of(st.none(), finite)), min_size=1, max_size=40))
def test_threshold_curve_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "s double, m double")
    edges = evaluate.linspace_edges()
    got = {r.i: r for r in evaluate.threshold_curve(df, ["s"], "m").collect()}
    prev = 0
    for i, t in enumerate(edges):
        acc = [(s, m) for s, m in rows if s is not None and s < t]
        ms = [m for _, m in acc if m is not None]
        r = got[i]
        assert r.accepted == len(acc)
        assert r.accepted >= prev  # counts never fall
        prev = r.accepted
        assert math.isclose(r.accept_pct, len(acc) / len(rows) * 100.0, abs_tol=1e-9)
        if ms:
            assert math.isclose(r.mean_measure, sum(ms) / len(ms), rel_tol=1e-9, abs_tol=1e-12)
        else:
            assert r.mean_measure is None


@SETTINGS
@given(st.lists(finite, min_size=1, max_size=30), st.lists(st.floats(0.0, 3.0), min_size=2, max_size=6, unique=True))
def test_bucket_index_general_edges(spark, xs, edges):
    edges = sorted(edges)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(evaluate.bucket_index("x", edges)).collect()]
    assert got == [sum(1 for e in edges if e <= x) for x in xs]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), finite), min_size=1, max_size=40),
       st.lists(st.floats(0.0, 1.0), min_size=1, max_size=4))
def test_exact_quantiles_match_numpy(spark, rows, probs):
    df = spark.createDataFrame(rows, "g int, v double")
    out = {r.g: r.asDict() for r in quantiles.exact_quantiles(df, "v", probs, by=["g"]).collect()}
    for g in {g for g, _ in rows}:
        vals = np.array([v for gg, v in rows if gg == g])
        for p in probs:
            name = f"q{round(float(p) * 100, 4):g}".replace(".", "_")
            assert math.isclose(out[g][name], float(np.quantile(vals, p)), rel_tol=1e-9, abs_tol=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 25), st.sampled_from(["f1", "f2", "f3"]),
                          st.floats(-5, 5).filter(lambda v: v == 0 or abs(v) > 1e-6)),
                min_size=1, max_size=40))
def test_sparse_corr_equals_dense(spark, cells):
    keys = list(range(26))
    y = {k: math.sin(k) + 0.1 * k for k in keys}
    dense = {f: np.zeros(len(keys)) for f in ["f1", "f2", "f3"]}
    for k, f, v in cells:
        dense[f][k] += v
    long = spark.createDataFrame([(k, f, v) for k, f, v in cells], "k int, feature string, value double") \
        .groupBy("k", "feature").agg(F.sum("value").alias("value")).where("value != 0")
    rows = spark.createDataFrame([(k, y[k]) for k in keys], "k int, y double")
    got = {r.feature: r.corr for r in selection.target_corr(long, rows, ["k"], "y", ["f1", "f2", "f3"]).collect()}
    yv = np.array([y[k] for k in keys])
    for f, x in dense.items():
        if np.all(x == x[0]):
            assert got[f] is None
        else:
            assert math.isclose(got[f], float(np.corrcoef(x, yv)[0, 1]), rel_tol=1e-7, abs_tol=1e-9)


@SETTINGS
@given(st.integers(1, 30), st.integers(1, 30))
def test_chi_square_zero_under_independence(spark, a, b):
    # a table whose rows are proportional: statistic is exactly 0
    rows = [("x", 1)] * a + [("x", 0)] * b + [("y", 1)] * (2 * a) + [("y", 0)] * (2 * b)
    s = fairness.chi_square_cells(spark.createDataFrame(rows, "g string, t int"), "g", "t").first()
    assert abs(s.chi2) < 1e-9


def test_percentages_sum_to_100(spark):
    from riskpanel.operators import profile
    df = spark.range(97).withColumn("c", (F.col("id") % 7).cast("string"))
    tot = profile.value_counts(df, "c").agg(F.sum("percentage")).first()[0]
    assert math.isclose(tot, 100.0, rel_tol=1e-12)
