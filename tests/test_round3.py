"""Automatic bins, binned density, applied narrowing, mapping objects, dated files and the three-table posterior."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import fairness, profile, quality
from riskpanel.sources import lookups, readers, sinks


def values(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "v double")


@pytest.mark.parametrize("name", ["normal", "skewed", "no spread", "two", "one", "equal", "none"])
def test_automatic_bins_equal_numpy(spark, name):
    rng = np.random.default_rng(4)
    xs = {"normal": rng.normal(0, 1, 700), "skewed": rng.exponential(3, 500) ** 2, "no spread": [1.0] * 90 + [0.0, 5.0],
          "two": [1.0, 2.0], "one": [3.0], "equal": [2.0] * 9, "none": []}[name]
    df = values(spark, [*xs, None, float("nan")])
    if len(xs):
        counts, edges = np.histogram(xs, bins="auto")
        rows = sorted(profile.histogram(df, "v", "auto").collect(), key=lambda r: r.bin)
        assert profile.auto_bins(df, "v") == len(counts) == len(rows)
        assert [r["count"] for r in rows] == counts.tolist()
        assert np.allclose([r.lo for r in rows] + [rows[-1].hi], edges)
    else:
        assert profile.auto_bins(df, "v") == 1 and profile.histogram(df, "v", "auto").count() == 0


def test_binned_density_keeps_its_error_bound(spark):
    rng = np.random.default_rng(6)
    xs = np.concatenate([rng.normal(0, 1, 400), rng.normal(9, 0.2, 100), [50.0]])
    df = values(spark, [*xs, None, float("nan")])
    exact = {r.i: r for r in profile.density(df, "v").collect()}
    bw = xs.std(ddof=1) * len(xs) ** -0.2
    for bins in (64, 4096):
        got = {r.i: r for r in profile.binned_density(df, "v", bins=bins).collect()}
        bound = profile.density_error(bw, (xs.max() - xs.min()) / (bins - 1))
        worst = max(abs(got[i].density - exact[i].density) for i in exact)
        assert got.keys() == exact.keys() and all(got[i].x == exact[i].x for i in exact)
        assert worst <= bound + 1e-15 and (bins == 64) == (bound > 1e-5)
    assert profile.binned_density(values(spark, []), "v").count() == 0
    same = [(r.i, r.x, r.density) for r in profile.density(values(spark, [2.0, 2.0]), "v").orderBy("i").collect()]
    assert np.allclose([(r.i, r.x, r.density) for r in profile.binned_density(values(spark, [2.0, 2.0]), "v").orderBy("i").collect()], same)


def test_binned_density_cost_does_not_follow_rows_times_grid(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"))
    plan = profile.binned_density(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("posexplode"):]
    assert "Aggregate" in below and "Range" in below[below.index("Aggregate"):]  # the grid is exploded above the aggregate to bins


def test_narrowing_is_applied_and_checked(spark):
    rows = [(1, 2.0, 300.0, 0.5, "x", None, 2 ** 40), (-128, 127.0, -70000.0, 1.0, None, 3, 1), (0, -0.0, 0.0, 2.0, "y", 4, -1)]
    df = spark.createDataFrame(rows, "a int, b double, `c.d` double, e double, s string, n int, big long")
    small = quality.narrow(df)
    assert dict(small.dtypes) == {"a": "tinyint", "b": "tinyint", "c.d": "int", "e": "double", "s": "string", "n": "int", "big": "bigint"}
    back = small.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in df.dtypes])
    assert back.collect() == df.collect()
    types = {r.column: r.narrow_type for r in quality.narrow_types(df).collect()}
    fits = spark.createDataFrame([(None, 5.0)], "a int, b double")
    assert quality.narrow(fits, types=types).collect() == [(None, 5)]
    for bad in (128.0, 1.5, float("nan"), 1e300, float("inf")):
        with pytest.raises(Exception, match="does not fit tinyint"):
            quality.narrow(spark.createDataFrame([(1, bad)], "a int, b double"), types=types).collect()
    assert quality.narrow(df.limit(0)).count() == 0


def test_mapping_object_is_one_json_object(spark, tmp_path):
    pairs = {'q"uote': "a", "back\\slash": None, "line\nend": "x\ty", "é😀": "z", "": "empty", "A": "1", "a": "2"}
    df = spark.createDataFrame([(*p, "other") for p in pairs.items()], "k string, v string, value string").repartition(5)
    sinks.write_map_object(df, str(tmp_path / "m"), "k", "v")
    parts = [p for p in os.listdir(tmp_path / "m") if p.startswith("part-")]
    assert len(parts) == 1
    text = (tmp_path / "m" / parts[0]).read_text()
    assert json.loads(text) == pairs and list(json.loads(text)) == sorted(pairs, key=str.encode)
    assert {r.key: r.value for r in lookups.load_map(spark, str(tmp_path / "m")).collect()} == pairs
    sinks.write_map_object(spark.createDataFrame([(3, 1.5), (20, None)], "key int, value double"), str(tmp_path / "n"))
    assert {r.key: r.value for r in lookups.load_map(spark, str(tmp_path / "n")).collect()} == {"3": "1.5", "20": None}
    for bad in ([("a", 1), ("a", 1)], [(None, 1)]):
        with pytest.raises(ValueError):
            sinks.write_map_object(spark.createDataFrame(bad, "key string, value int"), str(tmp_path / "bad"))
    sinks.write_map_object(df.limit(0), str(tmp_path / "e"), "k", "v")
    assert lookups.load_map(spark, str(tmp_path / "e")).count() == 0


def test_dated_files_are_merged(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, 9)], "id int, x double, fold int").write.parquet(str(tmp_path / "train 2019-01-01.parquet"))
    spark.createDataFrame([(2, "new")], "id int, y string").write.parquet(str(tmp_path / "train 2018-01-01.parquet"))
    spark.createDataFrame([(3, float("nan"), "z")], "id int, x double, startdate string").write.parquet(str(tmp_path / "deep" / "train=2020-01-01"))
    got = {r.id: r.asDict() for r in readers.read_dated(spark, str(tmp_path)).collect()}
    assert got == {1: {"id": 1, "x": 2.0, "y": None, "startdate": "2019-01-01", "fold": 2},
                   2: {"id": 2, "x": None, "y": "new", "startdate": "2018-01-01", "fold": 1},
                   3: {"id": 3, "x": None, "y": None, "startdate": "2020-01-01", "fold": 3}}
    spark.createDataFrame([(1,)], "id int").write.parquet(str(tmp_path / "undated"))
    with pytest.raises(ValueError):
        readers.read_dated(spark, str(tmp_path))


def test_posterior_falls_back_row_by_row(spark):
    p = "p_a double, p_b double"
    last = spark.createDataFrame([("O'Neil", 0.8, 0.2), ("SMITH", 0.5, 0.5)], f"last string, {p}")
    first = spark.createDataFrame([("ann", 0.1, 0.3), ("ZOE", 0.0, 0.0)], f"first string, {p}")
    place = spark.createDataFrame([("10", 0.2, 0.1), ("20", 1.0, 0.0)], f"place string, {p}")
    rows = [(1, "oneil", "Ann!", "10"), (2, " O Neil ", "bob", "10"), (3, "smith", None, "20"), (4, "nobody", "ann", "10"),
            (5, "smith", "ann", "99"), (6, None, None, None), (7, "Smith", "zoe", "10"), (8, "--", "ann", "10")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, last string, first string, place string, p_a string")
    got = {r.id: (r.factors, None if r.post_a is None else round(r.post_a, 6), r.predicted)
           for r in fairness.class_with_fallback(df, ("last", last), ("first", first), ("place", place), ["a", "b"]).collect()}
    assert got == {1: (3, round(0.016 / 0.022, 6), "a"), 2: (2, round(0.16 / 0.18, 6), "a"), 3: (2, 1.0, "a"), 4: (None, None, None),
                   5: (None, None, None), 6: (None, None, None), 7: (2, round(2 / 3, 6), "a"), 8: (None, None, None)}
    with pytest.raises(ValueError):
        fairness.class_with_fallback(df, ("last", last.union(last)), ("first", first), ("place", place), ["a", "b"])


def test_class_table_without_windows(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("x", 1), ("y", 0), (None, 1), ("y", None), ("z", 7)], "k string, c int")
    by_key = {r.k: (r.p_0, r.p_1) for r in fairness.class_table(df, "k", "c", ["0", "1"]).collect()}
    assert by_key == {"x": (1 / 3, 2 / 3), "y": (1.0, 0.0), "z": (0.0, 0.0)}
    by_class = {r.k: (r.p_0, r.p_1) for r in fairness.class_table(df, "k", "c", ["0", "1"], given="class").collect()}
    assert by_class == {"x": (0.5, 1.0), "y": (0.5, 0.0), "z": (0.0, 0.0)}
    assert "Window" not in fairness.class_table(df, "k", "c", ["0", "1"])._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [5, 60, 1_000_000])
def test_ranks_are_exact_however_often_buckets_are_split(spark, few):
    from riskpanel.operators import quantiles
    rng = np.random.default_rng(3)
    xs = {"a": rng.normal(0, 1e6, 900).round(1), "b": np.concatenate([np.full(400, 7.0), rng.random(50)]), "c": np.array([1.0]), "d": np.arange(5.0)}
    rows = spark.createDataFrame([(g, float(x)) for g, v in xs.items() for x in v], "g string, __v double").repartition(3)
    wanted = F.array(F.lit(0), (F.col("__n") / 2).cast("int"), F.col("__n") - 1)
    got = {}
    for r in quantiles.select_ranks(rows, ["g"], F.array_distinct(F.transform(wanted, lambda x: x.cast("long"))), few=few).collect():
        got.setdefault((r.g, r["__n"]), {})[r["__rank"]] = r["__v"]
    want = {(g, len(v)): {k: sorted(v)[k] for k in {0, len(v) // 2, len(v) - 1}} for g, v in xs.items()}
    assert got == want
    every = quantiles.select_ranks(rows.select("__v"), [], F.array(F.lit(700).cast("long")), few=few).collect()
    assert [(r["__n"], r["__rank"], r["__v"]) for r in every] == [(1356, 700, sorted(np.concatenate([*xs.values()]))[700])]


def test_store_profile_equals_the_wide_panel(spark):
    from riskpanel.operators import store
    rng = np.random.default_rng(2)
    features = ["a_1", "a_2", "a_3", "b_1", "b_2", "c_1"]
    rows, cells, wide = [], [], []
    for i in range(60):
        state = [None, "x", "y"][i % 3]
        rows.append((i, state))
        row = dict.fromkeys(features)
        for fam in ("a", "b"):
            if rng.random() < 0.6:
                for f in features:
                    if f.startswith(fam):
                        row[f] = {"a_2": 5.0, "a_3": 0.0}.get(f, float(rng.integers(0, 3)))
                        if row[f] or f in ("a_2", "b_1"):  # some zero cells are stored
                            cells.append((i, f, row[f]))
                if not any(c[0] == i and c[1].startswith(fam) for c in cells):
                    cells.append((i, f"{fam}_1", 0.0))
        wide.append((i, state, *row.values()))
    cells += [(99, "c_1", 3.0)]  # no row of the panel
    long = spark.createDataFrame(cells, "id int, feature string, value double")
    frame = spark.createDataFrame(wide, "id int, state string, " + ", ".join(f"{f} double" for f in features))
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    keyed = spark.createDataFrame(rows, "id int, state string")
    got = {(r.state, r.column): r.pct_non_zero for r in store.prevalence(store.feature_profile(long, keyed, ["id"], names, "state"), ["state"]).collect()}
    want = {(r.state, r.column): r.pct_non_zero for r in profile.prevalence(frame, features, ["state"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    overall = store.feature_profile(long, keyed, ["id"], names)
    assert {r.column: round(r.pct_non_zero, 9) for r in store.prevalence(overall).collect()} == \
        {r.column: round(r.pct_non_zero, 9) for r in profile.prevalence(frame, features).collect()}
    from riskpanel.operators import selection
    assert {r.column for r in store.constant(overall).collect()} == {r.column for r in selection.constant_columns(frame, features).collect()} \
        >= {"a_2", "a_3", "c_1"}
    assert {r.column for r in store.all_missing(overall).collect()} == {"a_3", "c_1"}


def test_cross_correlation_keeps_a_small_spread_beside_a_large_mean(spark):
    from riskpanel.operators import selection
    rng = np.random.default_rng(7)
    n = 400
    a = 1e7 + rng.integers(0, 2, n)
    b = np.where(rng.random(n) < 0.5, 0.0, 1e6 + (a - 1e7) + rng.random(n))
    c = 1e7 + (a - 1e7) * 2 + rng.random(n)
    cols = {"s_a": a, "o_b": b, "o_c": c, "o_const": np.full(n, 3.0)}
    long = spark.createDataFrame([(i, f, float(v[i])) for f, v in cols.items() for i in range(n) if v[i]], "id int, feature string, value double")
    got = {r.other: r.corr for r in selection.cross_corr(long, ["id"], ["s_a"], "o_", ["o_b", "o_c", "o_const", "o_none"], n).collect()}
    assert abs(got["o_b"] - np.corrcoef(a, b)[0, 1]) < 1e-6 and abs(got["o_c"] - np.corrcoef(a, c)[0, 1]) < 1e-6
    assert got["o_const"] is None and got["o_none"] is None


def test_contingency_table_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 2), (None, 1)], "r string, c int")
    assert {(x.r, x.c): x["count"] for x in fairness.crosstab(df, "r", "c").collect()} == {("a", 1): 1, ("a", 2): 1, ("b", 1): 0, ("b", 2): 1}
    monkeypatch.setattr(fairness, "MAX_CELLS", 3)
    with pytest.raises(ValueError):
        fairness.crosstab(df, "r", "c")
