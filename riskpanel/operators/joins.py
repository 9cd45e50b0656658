"""The join shapes the panel uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def join_keys(left: DataFrame, right: DataFrame, left_on: str | Sequence[str],
              right_on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on differently named keys; both key columns are kept."""
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = [right_on] if isinstance(right_on, str) else list(right_on)
    cond: Column | None = None
    for a, b in zip(lk, rk):
        c = left[a] == right[b]
        cond = c if cond is None else cond & c
    return left.join(right, cond, how)


def join_valid_at(facts: DataFrame, periods: DataFrame, key: str, at: str,
                  valid_from: str, valid_to: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` plus ``valid_from <= at <= valid_to`` (SQL BETWEEN).

    The equality drives the shuffle; the range is a post-join filter inside the
    same join, so no key range is ever expanded.
    """
    p = periods.withColumnRenamed(key, f"__{key}")
    cond = (facts[key] == p[f"__{key}"]) & facts[at].between(p[valid_from], p[valid_to])
    return facts.join(p, cond, how).drop(f"__{key}")
