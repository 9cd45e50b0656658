"""Hot keys: one key or value holding a third of all rows must not change results."""

import numpy as np
from pyspark.sql import functions as F

from riskpanel.operators import evaluate, panel, profile, quantiles, reshape


def _hot(spark, n=3000):
    # key 0 holds a third of the rows; values repeat heavily on the hot key
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("t"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise((F.col("id") % 97) / 50.0).alias("v"))


def test_quantiles_with_hot_value(spark):
    df = _hot(spark).repartition(7)
    vals = np.array([r.v for r in df.collect()])
    got = quantiles.exact_quantiles(df, "v", [0.1, 0.5, 0.9]).first()
    for p, name in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
        assert abs(got[name] - float(np.quantile(vals, p))) < 1e-12


def test_latest_per_hot_key(spark):
    df = _hot(spark)
    lt = {r.k: r.t for r in panel.latest_per_key(df, ["k"], ["t"], ["t"]).collect()}
    assert lt[0] == max(i for i in range(3000) if i % 3 == 0)


def test_curve_and_counts_with_hot_value(spark):
    df = _hot(spark)
    rows = [(r.v, r.t) for r in df.collect()]
    c = {r.i: r.accepted for r in evaluate.threshold_curve(df, ["v"], "t").collect()}
    e = evaluate.linspace_edges()
    assert all(c[i] == sum(1 for v, _ in rows if v < e[i]) for i in (0, 100, 150, 151, 299))
    vc = {r.k: r["count"] for r in profile.value_counts(df, "k").collect()}
    assert vc[0] == 1000


def test_head_per_hot_group(spark):
    out = reshape.head_per_group(_hot(spark), "k", ["t"], 5)
    assert sorted(r.t for r in out.where("k = 0").collect()) == [0, 3, 6, 9, 12]
