"""Sources, sinks and the streaming scorer."""

import json
import os

import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import functions as F

from riskpanel.ml import models
from riskpanel.sources import lookups, readers, sinks
from riskpanel.streaming.scoring import score_stream


def test_fold_table_roundtrip_and_pruning(spark, tmpdir_path):
    df = spark.range(100).select(F.col("id").alias("party_id"), (F.col("id") % 5 + 1).cast("int").alias("fold"),
                                 (F.col("id") / 10).alias("x"))
    path = f"{tmpdir_path}/folds"
    sinks.write_folds(df, path)
    assert sorted(os.listdir(path))[:5] == [f"fold={i}" for i in range(1, 6)]
    back = readers.read_folds(spark, path, max_fold=3)
    assert back.count() == 60
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "fold" in plan
    # dynamic overwrite replaces only the folds written
    sinks.write_folds(df.where("fold = 1").withColumn("x", F.lit(-1.0)), path)
    again = readers.read_folds(spark, path)
    assert again.count() == 100 and again.where("fold = 1 AND x = -1").count() == 20


def test_report_map_names(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    sinks.write_report(df, f"{tmpdir_path}/rep", single_file=True)
    back = readers.read_csv(spark, f"{tmpdir_path}/rep", "k string, v double")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1.0), ("b", 2.0)]
    sinks.write_map(df, f"{tmpdir_path}/map", "k", "v")
    m = spark.read.json(f"{tmpdir_path}/map")
    assert {r.key: r.value for r in m.collect()} == {"a": 1.0, "b": 2.0}
    with open(f"{tmpdir_path}/zip.json", "w") as fh:
        json.dump({"10": "< 0.5", "11": "1 - 1.5"}, fh)
    zmap = lookups.load_map(spark, f"{tmpdir_path}/zip.json")
    zips = spark.createDataFrame([("10",), ("12",)], "zip string")
    got = {r.zip: r.zip_category for r in lookups.apply_map(zips, "zip", zmap, out="zip_category").collect()}
    assert got == {"10": "< 0.5", "12": None}
    sinks.write_names(spark, ["f1", " f2 ", "f3"], f"{tmpdir_path}/names")
    assert sorted(lookups.load_names(spark, f"{tmpdir_path}/names")) == ["f1", "f2", "f3"]


def test_feather_source(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/fe")
    for i in range(2):
        feather.write_feather(pa.table({"a": [i, i + 10], "b": ["x", "y"]}), f"{tmpdir_path}/fe/p{i}.feather")
    df = readers.read_table(spark, f"{tmpdir_path}/fe", fmt="feather", columns=["a"])
    assert sorted(r.a for r in df.collect()) == [0, 1, 10, 11]


def test_sql_template_binds(spark):
    spark.createDataFrame([(1, 5.0), (2, 7.0)], "k int, v double").createOrReplaceTempView("rp_t")
    out = readers.sql_template(spark, "SELECT sum(v) AS s FROM rp_t WHERE k >= :lo", lo=2)
    assert out.first().s == 7.0


def test_stream_scoring(spark, tmpdir_path):
    train = spark.createDataFrame([(float(i), "a" if i % 2 else "b", 2.0 * i + 1) for i in range(40)],
                                  "x double, c string, y double")
    model = models.fit_pipeline(train, ["x"], ["c"], models.lasso(0.001, label="y"), "y")
    src = f"{tmpdir_path}/incoming"
    batch = spark.createDataFrame([(i, float(i), "a") for i in range(10)], "party_id int, x double, c string")
    batch.write.parquet(f"{src}/b1")
    q = score_stream(spark, model, f"{src}/b1", batch.schema, ["x"], ["party_id"], query_name="rp_scores_test")
    q.awaitTermination(120)
    got = spark.table("rp_scores_test")
    assert got.count() == 10
    ref = {r.party_id: r.prediction for r in model.transform(batch).collect()}
    assert all(abs(r.y_pred - ref[r.party_id]) < 1e-9 for r in got.collect())


def test_drop_materialized(spark):
    from riskpanel.session import checkpoint_dir, drop_materialized, materialize
    t = materialize(spark.range(5), "probe")
    assert t.count() == 5
    drop_materialized(spark)
    base = checkpoint_dir(spark).replace("file:", "")
    assert not os.path.exists(f"{base}/tables")
