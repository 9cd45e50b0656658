"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.session import materialize

__all__ = ["materialize", "read", "only", "binary_values", "held", "give_back", "tidy", "partitions", "ranges"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Just the named columns, under internal names (``only(df, id='doc_id')``),
    so that clashing extra columns never reach an operator's own ones."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in cols.items()])


def binary_values(batch, name: str, rows: int = 256) -> Iterator[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes (null: None); of ``rows`` rows at a time there is a copy."""
    import pyarrow as pa
    column = batch.column(name)
    for first in range(0, len(column), rows):
        yield from column.slice(first, rows).cast(pa.large_binary()).to_pylist()


_held: dict = {}


def give_back() -> None:
    """Return freed memory of a Python worker (numpy's and Arrow's) to the system."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """``run`` for mapInArrow, as a task that keeps no memory after its end: workers live on and their freed pages
    count against the executor. Arrow takes memory from the system's allocator, which gives it back."""
    def wrapped(batches):
        import pyarrow as pa
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def held(name: str, make):
    """A Python worker's cache, kept over its tasks as long as they ask for the same one: a
    worker that turns to another operator gives the memory of the last one's back."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each start and length."""
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
