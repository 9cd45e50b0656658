"""Edge rules from FIXTURES.md section 4 on small hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from riskpanel.functions import binning as B
from riskpanel.functions.rowwise import row_argmax, row_mean
from riskpanel.functions.stats import chi2_sf_value
from riskpanel.functions.text import normalise_name, null_sentinel, strip, to_category
from riskpanel.ml.scoring import align
from riskpanel.ml.tuning import expanding_splits, sliding_splits
from riskpanel.operators import evaluate, fairness, panel, profile, quality, reshape, selection

EDGE_VALUES = [-1.0, 0.0, 0.2, 3 * 0.1, 0.5, 0.75, 1.0, 1.5, 2.0, 5.0, 10.0, None, float("nan")]


@pytest.fixture(scope="module")
def edges_df(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(EDGE_VALUES)], "i int, x double")


def _labels(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_band8(edges_df):
    assert _labels(edges_df, B.band8("x")) == [
        "< 0.5", "< 0.5", "< 0.5", "< 0.5", "0.5 - 0.75", "0.75 - 1", "1 - 1.5", "1.5 - 2", "2 - 5",
        "5 - 10", "10+", "10+", "10+"]


def test_band13(edges_df):
    assert _labels(edges_df, B.band13("x")) == [
        "0.0 - 0.2", "0.0 - 0.2", "0.2 - 0.3", "0.3 - 0.4", "0.5 - 0.6", "0.7 - 0.8", "1 - 1.25", "1.5 - 2",
        "2+", "2+", "2+", "2+", "2+"]


def test_band_step(edges_df):
    assert _labels(edges_df, B.band_step("x")) == [
        "2.0+", "0.0 - 0.1", "0.2 - 0.3", "0.3 - 0.4", "0.5 - 0.6", "0.7 - 0.8", "1.0 - 1.1", "1.5 - 1.6",
        "2.0+", "2.0+", "2.0+", "2.0+", "2.0+"]


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(B.flag("x", "<=", 1)).collect()] == [1, 1, 0, 0]


@pytest.fixture(scope="module")
def null_keys(spark):
    return spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), (None, None), ("b", 2.0)], "k string, v double")


def test_group_mean_drops_null_keys(null_keys):
    got = {r.k: r.v for r in profile.group_mean(null_keys, "k", ["v"]).collect()}
    assert got == {"a": 1.0, "b": 2.0}


def test_by_dimension_counts_non_null_target(null_keys):
    got = {(r.dimension, r.level): (r.n, r.mean) for r in profile.by_dimension(null_keys, ["k"], "v").collect()}
    assert got == {("k", "a"): (1, 1.0), ("k", "b"): (1, 2.0)}


def test_value_counts_excludes_null(null_keys):
    got = {r.k: (r["count"], round(r.percentage, 4)) for r in profile.value_counts(null_keys, "k").collect()}
    assert got == {"a": (2, 66.6667), "b": (1, 33.3333)}


def test_crosstab_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", None), ("b", 1)], "g string, t int")
    got = {(r.g, r.t): (r["count"], r.row_share) for r in fairness.crosstab(df, "g", "t").collect()}
    assert got == {("a", 1): (1, 0.5), ("a", 0): (1, 0.5), ("b", 1): (1, 1.0), ("b", 0): (0, 0.0)}


def test_pivot_zero_fill_and_names(spark):
    df = spark.createDataFrame([(1, "A", 1.0, 1.0), (1, "A", 2.0, 1.0), (1, "B", None, None), (2, "B", 3.0, 1.0)],
                               "k int, cat string, V2 double, V1 double")
    out = panel.pivot_features(df, ["k"], "cat", ["V2", "V1"], ["A", "B", "C"])
    assert out.columns == ["k", "v1_a", "v1_b", "v1_c", "v2_a", "v2_b", "v2_c"]
    rows = {r.k: r.asDict() for r in out.collect()}
    assert rows[1]["v2_a"] == 3.0 and rows[1]["v2_b"] == 0.0 and rows[1]["v2_c"] == 0.0
    assert rows[2]["v2_a"] == 0.0 and rows[2]["v2_b"] == 3.0


def test_pivot_long_and_melt_roundtrip(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 0.0, 4.0)], "k int, a double, b double")
    long = reshape.melt(df, ["k"], ["a", "b"], "feature", "value")
    assert long.count() == 4  # the NULL cell is kept
    back = panel.pivot_long(long, ["k"], ["a", "b"]).orderBy("k")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.orderBy("k").collect()]


def test_constant_column_rules(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "x double, y double")
    from riskpanel.functions.stats import safe_corr
    assert df.agg(safe_corr("x", "y")).first()[0] is None
    assert [r.column for r in selection.constant_columns(df).collect()] == ["x"]
    assert selection.drop_constant(df).columns == ["y"]
    assert evaluate.corr_matrix(df, ["x", "y"]).where("col_a = 'x' AND col_b = 'y'").first().corr is None
    from riskpanel.ml.models import fit_preprocessor
    prep = fit_preprocessor(df, ["x"], [])
    assert [r.features[0] for r in prep.transform(df).collect()] == [5.0, 5.0, 5.0]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.5, 300, 70000), (2.0, None, 2.0, 1, 1)],
                               "a double, b double, c double, d bigint, e bigint")
    got = {r.column: r.narrow_type for r in quality.narrow_types(df).collect()}
    assert got == {"a": "tinyint", "b": "double", "c": "double", "d": "smallint", "e": "int"}


def test_text_rules(spark):
    df = spark.createDataFrame([(0, "a "), (1, None), (2, " Unknown")], "i int, s string")
    assert _labels(df, strip("s")) == ["a", None, "Unknown"]
    assert _labels(df, to_category("s")) == ["a", "None", "Unknown"]
    assert _labels(df, null_sentinel(strip("s"))) == ["a", None, None]


def test_all_missing_needs_every_fold(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, None)], "fold int, x double, z double")
    assert [r.column for r in quality.all_missing(df, "fold").collect()] == ["z"]


def test_threshold_ties_and_empty(spark):
    e = evaluate.linspace_edges()
    df = spark.createDataFrame([(0.0, 1.0), (e[5], 2.0), (2.0, 3.0), (3.0, 4.0), (None, 5.0)], "s double, m double")
    c = {r.i: r for r in evaluate.threshold_curve(df, ["s"], "m").collect()}
    assert c[0].accepted == 0 and c[0].mean_measure is None
    assert c[5].accepted == 1 and c[6].accepted == 2          # strict '<' at the tied edge
    assert c[299].accepted == 2 and c[299].accept_pct == 40.0  # 2.0 is never below the last edge
    high = spark.createDataFrame([(2.0, 1.0), (7.0, 2.0)], "s double, m double")
    assert all(r.accepted == 0 and r.mean_measure is None
               for r in evaluate.threshold_curve(high, ["s"], "m").collect())


def test_chi_square_two_by_two(spark):
    rows = [("A", 1)] * 30 + [("A", 0)] * 20 + [("B", 1)] * 15 + [("B", 0)] * 35
    df = spark.createDataFrame(rows, "g string, t int")
    s = fairness.chi_square(df, "g", "t").first()
    assert s.dof == 1 and abs(s.chi2 - 9.090909) < 1e-5 and abs(s.p_value - 0.002569) < 1e-5
    p = fairness.pairwise_chi_square(df, "g", "t").first()
    assert abs(p.chi2 - s.chi2) < 1e-9 and abs(chi2_sf_value(9.0909, 1) - 0.00257) < 1e-4


def test_argmax_ties_and_nulls(spark):
    df = spark.createDataFrame([(0, 0.5, 0.5, 0.1), (1, None, None, None), (2, None, 0.2, 0.3)],
                               "i int, a double, b double, c double")
    assert _labels(df, row_argmax(["a", "b", "c"])) == ["a", None, "c"]
    assert _labels(df, row_mean(["a", "b", "c"])) == [pytest.approx(1.1 / 3), None, pytest.approx(0.25)]


def test_feature_alignment(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 9.0)], "party_id int, `ccs_3mos_240.0` double, ccs_6mos_1 double, extra double")
    out = align(df, ["ccs_3mos_240_0", "ccs_6mos_1", "absent_f"], keep=["party_id"])
    assert out.columns == ["party_id", "ccs_3mos_240_0", "ccs_6mos_1", "absent_f"]
    assert tuple(out.first()) == (1, 2.0, 3.0, 0.0)
    assert normalise_name("a.0.0") == "a_0_0"


def test_one_hot_unknown_is_zero(spark):
    from riskpanel.ml.models import fit_preprocessor
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    prep = fit_preprocessor(train, [], ["c"])
    score = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "q"), (4, None)], "i int, c string")
    got = [list(r.features.toArray()) for r in prep.transform(score).orderBy("i").collect()]
    assert got == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_dummies(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "i int, c string")
    out = reshape.dummies(df, "c")
    assert out.columns == ["i", "c_y"]
    assert [r.c_y for r in out.orderBy("i").collect()] == [0, 1, 0]


def test_splits():
    assert sliding_splits([1, 2, 3, 4, 5]) == [([1], 2), ([2], 3), ([3], 4)]
    assert expanding_splits([1, 2, 3, 4, 5]) == [([1], 2), ([1, 2], 3), ([1, 2, 3], 4)]
    assert sliding_splits([1, 2, 3, 4, 5], train_span=2) == [([1, 2], 3), ([2, 3], 4)]
    for train, test in sliding_splits(list(range(1, 9)), train_span=3) + expanding_splits(list(range(1, 9))):
        assert max(train) < test  # no training fold after its test fold


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([(1, 10, "x", None), (1, 20, "y", 7.0), (1, 30, None, 8.0), (2, 5, "z", None)],
                               "k int, t int, a string, b double")
    lt = {r.k: (r.a, r.b) for r in panel.latest_per_key(df, ["k"], ["t"], ["a", "b"]).collect()}
    assert lt == {1: (None, 8.0), 2: ("z", None)}
    fp = {r.k: (r.a, r.b) for r in panel.first_per_key(df, ["k"], "t").collect()}
    assert fp == {1: ("x", 7.0), 2: ("z", None)}


def test_weighted_sample_skips_zero_weight(spark):
    df = spark.range(1000).withColumn("w", F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    s = reshape.weighted_sample(df, n=100, weight="w", seed=3)
    rows = s.collect()
    assert len(rows) == 100 and all(r.w > 0 for r in rows)


def test_head_per_group(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 3)
    out = reshape.head_per_group(df, "g", ["id"], 4)
    got = sorted((r.g, r.id) for r in out.collect())
    assert got == sorted((g, i) for g in range(3) for i in [x for x in range(50) if x % 3 == g][:4])


def test_transpose_small(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "g string, x double, y double")
    t = {r.column: (r.a, r.b) for r in reshape.transpose(df, "g").collect()}
    assert t == {"x": (1.0, 3.0), "y": (2.0, 4.0)}


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "v double")
    h = {r.bin: r["count"] for r in profile.histogram(df, "v", 4).collect()}
    assert h == {0: 1, 1: 0, 2: 1, 3: 2}


def test_chi2_tail_matches_known_values():
    assert math.isclose(chi2_sf_value(5.0, 3), 0.171797, rel_tol=1e-5)
    assert math.isclose(chi2_sf_value(20.0, 10), 0.029253, rel_tol=1e-4)


def test_nan_to_null_and_group_mean(spark):
    from riskpanel.operators.cleaning import nan_to_null
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), (None, 3.0)], "k string, v double")
    clean = nan_to_null(df)
    assert [r.v for r in clean.orderBy("v").collect()].count(None) == 1
    assert {r.k: r.v for r in profile.group_mean(clean, "k", ["v"]).collect()} == {"a": 1.0}


def test_split_guard():
    from riskpanel.ml.tuning import check_splits
    check_splits([([1, 2], 3)])
    with pytest.raises(ValueError):
        check_splits([([1, 2, 3], 3)])


def test_expected_counts(spark):
    rows = [("A", 1)] * 30 + [("A", 0)] * 20 + [("B", 1)] * 15 + [("B", 0)] * 35
    e = {(r.g, r.t): r.expected for r in fairness.expected_counts(spark.createDataFrame(rows, "g string, t int"),
                                                                 "g", "t").collect()}
    assert e == {("A", 1): 22.5, ("A", 0): 27.5, ("B", 1): 22.5, ("B", 0): 27.5}


def test_read_query_on_catalog(spark):
    from riskpanel.sources.readers import read_query
    spark.range(3).createOrReplaceTempView("rp_q")
    assert read_query(spark, "SELECT sum(id) AS s FROM rp_q").first().s == 3


def test_features_long_matches_pivot(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "A", 2.0), (1, "B", 0.0), (2, "B", 3.0)], "k int, cat string, V double")
    long = {(r.k, r.feature): r.value for r in panel.features_long(df, ["k"], "cat", ["V"]).collect()}
    assert long == {(1, "v_a"): 3.0, (2, "v_b"): 3.0}  # zeros implicit
    wide = panel.pivot_features(df, ["k"], "cat", ["V"], ["A", "B"])
    assert {(r.k, f): r[f] for r in wide.collect() for f in ("v_a", "v_b") if r[f] != 0} == long


def test_column_helpers(spark):
    from riskpanel.operators import columns
    from riskpanel.operators.joins import join_keys
    df = spark.createDataFrame([(1, "x", 2.0)], "PARTY_ID int, Plan string, `ccs_3mos_1.0` double")
    assert columns.matching(df, regex="^ccs_") == ["ccs_3mos_1.0"]
    assert columns.of_type(df, ["number"]) == ["PARTY_ID", "ccs_3mos_1.0"]
    r = columns.rename(df, lower=True, pattern=(r"\.0", "_0"))
    assert r.columns == ["party_id", "plan", "ccs_3mos_1_0"]
    other = spark.createDataFrame([(1, 7.0)], "party_id int, score double")
    assert columns.attach(r, other, ["party_id"]).columns == ["party_id", "plan", "ccs_3mos_1_0", "score"]
    j = join_keys(df, other.withColumnRenamed("party_id", "pid"), "PARTY_ID", "pid", "left")
    assert set(j.columns) == {"PARTY_ID", "Plan", "ccs_3mos_1.0", "pid", "score"} and j.count() == 1
