"""Batch scoring under Structured Streaming.

Scoring (P8 align + M5 transform) is stateless, so a fitted pipeline runs
unchanged on a streaming DataFrame: each new file of member rows dropped in
the source folder is aligned to the model's features and scored. Progress
lives in the checkpoint location, so a restarted query resumes where it
stopped, and a file sink commits each micro-batch exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from riskpanel.ml.scoring import align, score
from riskpanel.session import checkpoint_dir


def score_stream(spark: SparkSession, model: PipelineModel, source: str, schema: StructType,
                 features: Sequence[str], keep: Sequence[str], sink: str | None = None,
                 checkpoint: str | None = None, query_name: str | None = None,
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start a query scoring every Parquet file that lands in ``source``.

    ``sink`` is a Parquet folder (exactly-once file sink); without it the
    results go to an in-memory table named ``query_name`` (tests, notebooks).
    ``available_now`` processes what is there in bounded batches and stops.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    rows = reader.parquet(source)
    scored = score(model, align(rows, features, keep=list(keep) + [c for c in model_inputs(model)
                                                                   if c not in features and c not in keep]),
                   keep=keep)
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/{query_name or uuid.uuid4().hex}"
    writer = scored.writeStream.option("checkpointLocation", ckpt).outputMode("append")
    if sink:
        writer = writer.format("parquet").option("path", sink)
    else:
        writer = writer.format("memory").queryName(query_name or f"scores_{uuid.uuid4().hex[:8]}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def model_inputs(model: PipelineModel) -> list[str]:
    """Raw text columns the fitted preprocessor reads (one-hot inputs)."""
    import re
    stmt = model.stages[0].getStatement() if hasattr(model.stages[0], "getStatement") else ""
    return sorted({c.replace("``", "`") for c in re.findall(r"CAST\(`((?:[^`]|``)+)` AS STRING\) AS __txt", stmt)})
