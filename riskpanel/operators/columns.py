"""Column selection and naming."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions import text as T


def matching(df: DataFrame, regex: str | None = None, like: str | None = None,
             prefix: str | None = None) -> list[str]:
    """Column names by regex search (``filter(regex=)``), substring (``like``) or prefix."""
    cols = df.columns
    if regex is not None:
        cols = [c for c in cols if re.search(regex, c)]
    if like is not None:
        cols = [c for c in cols if like in c]
    if prefix is not None:
        cols = [c for c in cols if c.startswith(prefix)]
    return cols


def of_type(df: DataFrame, kinds: Sequence[str]) -> list[str]:
    """Column names by type family: 'number', 'integer', 'float', 'string'."""
    fam = {"integer": ("tinyint", "smallint", "int", "bigint"), "float": ("float", "double"),
           "string": ("string",)}
    fam["number"] = fam["integer"] + fam["float"]
    wanted = {t for k in kinds for t in fam.get(k, (k,))}
    return [c for c, t in df.dtypes if t in wanted or (t.startswith("decimal") and "number" in kinds)]


def rename(df: DataFrame, mapping: Mapping[str, str] | None = None, lower: bool = False,
           strip_prefix: str | None = None, pattern: tuple[str, str] | None = None) -> DataFrame:
    """P5: explicit, lower-case, prefix-strip and regex renames in one projection."""
    def new(c: str) -> str:
        n = (mapping or {}).get(c, c)
        if strip_prefix and n.startswith(strip_prefix):
            n = n[len(strip_prefix):]
        if pattern:
            n = re.sub(pattern[0], pattern[1], n)
        return n.lower() if lower else n
    return df.select(*[F.col(f"`{c}`").alias(new(c)) for c in df.columns])


def label_features(names: DataFrame, labels: DataFrame, name: str = "feature", code: str = "code",
                   label: str = "label", sep: str = "_") -> DataFrame:
    """``feature -> 'code - label'`` via the code after the last separator and a
    lookup join; unmatched codes keep the feature name (``coalesce``)."""
    n = names.select(name, T.last_token(name, sep).alias("__code"))
    lab = labels.select(F.col(code).cast("string").alias("__code"), F.col(label).alias("__label"))
    j = n.join(lab, "__code", "left")
    return j.select(name, F.coalesce(T.code_label("__code", "__label"), F.col(name)).alias("labelled"))


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Column-wise concatenation aligned by key (never by row position)."""
    return left.join(right, list(keys), how)
