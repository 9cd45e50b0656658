"""Lookups (S7, S8, P10): key -> value maps and name lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A mapping as a two-column table: JSON Lines of ``{key, value}`` pairs, or one
    JSON object ``{key: value, ...}`` per file (values as text).

    An object is parsed as a map, so keys that differ by case only, or hold dots,
    stay apart, and no column per key is made.
    """
    first = spark.read.text(path).where(F.trim("value") != "").first()
    try:
        pair = first is not None and set(json.loads(first[0])) == {key, value}
    except ValueError:  # an object written over several lines
        pair = False
    if pair:
        return spark.read.json(path).select(F.col(key).cast("string").alias(key), value)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def load_names(spark: SparkSession, path: str) -> list[str]:
    """A one-name-per-line list (feature or drop list), trimmed, blanks skipped.

    Name lists describe columns, so they are schema-sized and returned to the driver.
    """
    rows = (spark.read.text(path)
            .select(F.trim("value").alias("name"))
            .where(F.col("name") != "")
            .collect())
    return [r.name for r in rows]


def apply_map(df: DataFrame, column: str, mapping: DataFrame, key: str = "key",
              value: str = "value", out: str | None = None) -> DataFrame:
    """P10: map ``column`` through a lookup; unmatched keys give NULL.

    Whether the lookup is broadcast is left to its size statistics and AQE.
    """
    out = out or f"{column}_mapped"
    m = mapping.select(F.col(key).alias("__k"), F.col(value).alias(out))
    return df.join(m, df[column].cast("string") == m["__k"], "left").drop("__k")
