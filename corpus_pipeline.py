"""Corpus pipeline: toxic texts go, one text of each near-duplicate group stays, repeated passages are
cut, texts that hold benchmark items go, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's result as Parquet
in the shared folder and reads it again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from riskpanel.llm.common import materialize, read
from riskpanel.llm.queries import END_ID, TOXIC_AT, tokenizer, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity_model(spark, docs, sf_dir), TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, radius=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated 200-byte strings; n_chars follows."""
    return suffix_dedup.strip_repeats(docs, length=200) \
        .withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), END_ID, 1024).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("suffix_array", cut_repeats),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: A trained model and suffix sorting can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
