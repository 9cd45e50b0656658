"""Profiles of the wide panel read off the long feature store (A9, A10, P11), without an aggregate per column.

The panel's cells follow from the store: a row of which a block (the features of one family) has no cell at all is NULL in the whole block, a
row with some of its cells is 0 in the others. So counts of rows, of rows with the block and of non-zero cells say what
an aggregate over the wide column would, for any number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_profile(long: DataFrame, rows: DataFrame, keys: Sequence[str], features: DataFrame, by: str | None = None,
                    feature: str = "feature", value: str = "value", family_sep: str = "_") -> DataFrame:
    """``([by], feature, rows, present, non_zero, lowest, highest)`` for every listed feature (and group of ``rows``).

    ``rows`` has the panel's rows (one a key, with ``by``), ``long`` the store (one row a key and feature), ``features`` the names
    (column ``feature``); a family is a name up to its first ``family_sep``. ``lowest`` and ``highest`` are those of the
    non-zero cells. The result has features x groups rows, its only product; rows with a NULL group are one group.
    """
    group = [F.col(by).alias("__g")] if by else [F.lit(0).alias("__g")]
    own = rows.select(*keys, *group)
    family = F.substring_index(F.col("feature"), family_sep, 1)
    cells = long.select(*keys, F.col(feature).alias("feature"), F.col(value).alias("value")).join(own, list(keys))
    present = cells.select(*keys, "__g", family.alias("__family")).distinct().groupBy("__g", "__family").agg(F.count("*").alias("present"))
    stats = cells.where("value != 0").groupBy("__g", "feature").agg(
        F.count("*").alias("non_zero"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    totals = own.groupBy("__g").agg(F.count("*").alias("rows")).withColumn("__all", F.lit(1))
    grid = features.select("feature", family.alias("__family"), F.lit(1).alias("__all")).join(totals, "__all")

    def add(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        r = right.withColumnsRenamed({"__g": "__g2", name: "__n2"})
        return left.join(r, F.col("__g").eqNullSafe(F.col("__g2")) & (F.col(name) == F.col("__n2")), "left").drop("__g2", "__n2")

    out = add(add(grid, present, "__family"), stats, "feature")
    return out.select(*([F.col("__g").alias(by)] if by else []), "feature", "rows", F.coalesce("present", F.lit(0)).alias("present"),
                      F.coalesce("non_zero", F.lit(0)).alias("non_zero"), "lowest", "highest")


def all_missing(profile: DataFrame) -> DataFrame:
    """Features without a non-zero value in any group."""
    return profile.groupBy(F.col("feature").alias("column")).agg(F.max("non_zero").alias("m")).where("m = 0").select("column")


def prevalence(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A10: percent of rows whose value is non-zero, NULL counting as such."""
    full = F.col("rows") - F.col("present") + F.col("non_zero")
    return profile.select(*by, F.col("feature").alias("column"), (full / F.col("rows") * 100.0).alias("pct_non_zero"))


def constant(profile: DataFrame) -> DataFrame:
    """Features with at most one distinct non-null value (profile without groups)."""
    same = (F.col("non_zero") == 0) | ((F.col("non_zero") == F.col("present")) & (F.col("lowest") == F.col("highest")))
    return profile.where(same).select(F.col("feature").alias("column"))
