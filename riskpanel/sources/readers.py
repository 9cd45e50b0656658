"""Readers (S1-S6): warehouse queries, SQL templates, files and fold tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskpanel.operators.cleaning import nan_to_null


def read_query(spark: SparkSession, query: str, *, url: str | None = None,
               properties: Mapping[str, str] | None = None,
               partition_column: str | None = None, lower_bound: int | None = None,
               upper_bound: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Run a query where the data lives.

    With ``url`` the query is pushed to the database through JDBC and read
    in ``num_partitions`` parallel ranges of ``partition_column`` (one
    connection per range); without a partition column the database gives one
    connection, so one task. Without a url the query runs on Spark's own catalog (tables / temp views).
    """
    if url is None:
        return spark.sql(query)
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        if lower_bound is None or upper_bound is None or lower_bound >= upper_bound:
            raise ValueError("a partitioned read needs lower_bound < upper_bound")
        # JDBC does not allow "query" together with partitionColumn: wrap as dbtable.
        reader = (spark.read.format("jdbc").option("url", url)
                  .option("dbtable", f"({query}) q")
                  .option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound))
                  .option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions or 64)))
        for k, v in (properties or {}).items():
            reader = reader.option(k, v)
    return reader.load()


def sql_template(spark: SparkSession, text: str, **params) -> DataFrame:
    """A parameterised SQL template; values are bound (``:name`` markers),
    never pasted into the text."""
    return spark.sql(text, args=params)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read one table; ``columns`` is a projection Catalyst prunes into the scan."""
    if fmt == "feather":
        from riskpanel.sources.feather import register_feather
        register_feather(spark)
        df = spark.read.format("feather").load(path)
    else:
        df = spark.read.format(fmt).load(path)
    return nan_to_null(df.select(*columns) if columns else df)  # NaN is missing from here on


def read_folds(spark: SparkSession, path: str, *, folds: Sequence[int] | None = None,
               max_fold: int | None = None, glob: str | None = None,
               partition_column: str = "fold") -> DataFrame:
    """One scan over a fold-partitioned table instead of a loop over files.

    The fold filter prunes partitions (directories) before any file is opened.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.parquet(path)
    if folds is not None:
        df = df.where(F.col(partition_column).isin(list(folds)))
    if max_fold is not None:
        df = df.where(F.col(partition_column) <= max_fold)
    return nan_to_null(df)


def read_dated(spark: SparkSession, path: str, pattern: str = r"train[ =](\d{4}-\d{2}-\d{2})", date: str = "startdate",
               fold: str = "fold", glob: str | None = None) -> DataFrame:
    """Files that carry their date in their name, of differing columns, in one scan.

    The date is taken from the file's path (``pattern``'s group), the fold is its place among the dates of all files, and schemas
    are merged: a column that a file lacks is NULL in its rows. A file without a date is an error. ``date`` and ``fold`` replace
    columns of these names.
    """
    reader = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    files = df.inputFiles()  # as many as the folder lists
    found = {f: re.search(pattern, unquote(f)) for f in files}
    undated = [f for f, m in found.items() if m is None]
    if undated:
        raise ValueError(f"no date in the name of {undated[:5]}")
    dates = sorted({m[1] for m in found.values()})
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), pattern, 1)
    kept = [c for c in df.columns if c not in (date, fold)]
    out = df.select(*[F.col(f"`{c}`") for c in kept], name.alias(date))
    return nan_to_null(out.withColumn(fold, F.array_position(F.array(*[F.lit(d) for d in dates]), F.col(date)).cast("int")))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV with an explicit schema (no inference pass over the data)."""
    reader = spark.read.option("header", str(header).lower())
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    return nan_to_null(reader.csv(path))
