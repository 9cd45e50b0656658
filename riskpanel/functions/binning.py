"""Band and flag expressions (B1-B3, C13). All are native ``CASE WHEN`` chains.

Null and NaN never satisfy ``x < edge`` in Spark, so they fall to the last
label, as the reference's if/elif chain sends NaN to its final ``else``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values that must equal the reference's band definitions -------
# B1: 8-level band of a mean A/E (edges and labels as written)
BAND8_EDGES = [0.5, 0.75, 1, 1.5, 2, 5, 10]
BAND8_LABELS = ["< 0.5", "0.5 - 0.75", "0.75 - 1", "1 - 1.5", "1.5 - 2", "2 - 5", "5 - 10", "10+"]
# B2: 13-level A/E group; 14 edges are listed, the chain uses the first 12.
# Labels kept exactly as written, including "0.6- 0.7" and "0.9- 1".
BAND13_EDGES = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1, 1.25, 1.5, 2, 5, 10]
BAND13_LABELS = ["0.0 - 0.2", "0.2 - 0.3", "0.3 - 0.4", "0.4 - 0.5", "0.5 - 0.6", "0.6- 0.7",
                 "0.7 - 0.8", "0.8 - 0.9", "0.9- 1", "1 - 1.25", "1.25 - 1.5", "1.5 - 2", "2+"]
# 0.1-step bands from 0.0 to 2.0, labels "<lo> - <hi>" and "2.0+"
STEP_BAND_START, STEP_BAND_STOP, STEP_BAND_STEP = 0.0, 2.0, 0.1
# --------------------------------------------------------------------------


def band(col: Column | str, edges: Sequence[float], labels: Sequence[str],
         lower_open: bool = True) -> Column:
    """Left-closed banding ``[e_i, e_{i+1})``.

    ``lower_open=True``: ``len(labels) == len(edges) + 1``; values below the first
    edge get ``labels[0]``. ``lower_open=False``: ``len(labels) == len(edges)``;
    the bands start at ``edges[0]`` and everything outside (below, above, null,
    NaN) takes the last label.
    """
    x = F.col(col) if isinstance(col, str) else col
    edges = [float(e) for e in edges]
    if lower_open:
        if len(labels) != len(edges) + 1:
            raise ValueError("need len(edges) + 1 labels")
        expr = F.when(x < F.lit(edges[0]), F.lit(labels[0]))
        for i in range(1, len(edges)):
            expr = expr.when(x < F.lit(edges[i]), F.lit(labels[i]))
        return expr.otherwise(F.lit(labels[-1]))
    if len(labels) != len(edges):
        raise ValueError("need len(edges) labels")
    expr = None
    for i in range(len(edges) - 1):
        cond = (x >= F.lit(edges[i])) & (x < F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr.otherwise(F.lit(labels[-1]))


def step_edges(start: float = STEP_BAND_START, stop: float = STEP_BAND_STOP,
               step: float = STEP_BAND_STEP) -> list[float]:
    """Edges rounded to one decimal, so ``3 * 0.1`` is the edge ``0.3``."""
    n = int(round((stop - start) / step))
    return [round(start + i * step, 1) for i in range(n + 1)]


def step_labels(edges: Sequence[float]) -> list[str]:
    return [f"{edges[i]} - {edges[i + 1]}" for i in range(len(edges) - 1)] + [f"{edges[-1]}+"]


def band8(col: Column | str) -> Column:
    """B1."""
    return band(col, BAND8_EDGES, BAND8_LABELS)


def band13(col: Column | str) -> Column:
    """B2 (the first 12 edges drive the 13 labels)."""
    return band(col, BAND13_EDGES[: len(BAND13_LABELS) - 1], BAND13_LABELS)


def band_step(col: Column | str, start: float = STEP_BAND_START, stop: float = STEP_BAND_STOP,
              step: float = STEP_BAND_STEP) -> Column:
    """0.1-step bands; negatives, values >= stop, null and NaN go to ``'<stop>+'``."""
    e = step_edges(start, stop, step)
    return band(col, e, step_labels(e), lower_open=False)


def flag(col: Column | str, op: str, threshold: float) -> Column:
    """1 when ``col <op> threshold`` holds, else 0 (null gives 0)."""
    x = F.col(col) if isinstance(col, str) else col
    t = F.lit(float(threshold))
    cond = {">=": x >= t, ">": x > t, "<=": x <= t, "<": x < t, "==": x == t}[op]
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
