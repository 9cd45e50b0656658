"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes,
# splits skewed shuffle partitions and coalesces tiny ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # wide member-level rows (one column per code and window) stay in generated code
    "spark.sql.codegen.maxFields": "1000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskpanel", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset, only a
    local-mode session gets a scratch folder of its own; on a cluster that folder
    would be a different one on every machine, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riskpanel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where one expensive intermediate feeds several branches of a plan
    (Catalyst's inferred filters can make the branches differ, so the shuffle
    would not be reused): the work runs once, the table survives lost
    executors, and readers get column pruning and filter pushdown.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables ``materialize`` (and the I/O round trips) wrote under the
    checkpoint folder. Call once the DataFrames reading them are no longer needed."""
    jvm = spark._jvm
    base = checkpoint_dir(spark).rstrip("/")
    conf = spark._jsc.hadoopConfiguration()
    for sub in ("tables", "io"):
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{sub}")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            fs.delete(path, True)
