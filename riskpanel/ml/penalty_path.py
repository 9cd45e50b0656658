"""Whole Lasso penalty paths from one pass over the rows (M2, V3).

Least squares needs of a fold only its cross products. ``fold_products`` makes them for all folds in one pass over the sparse vectors: a
task adds up its rows of a fold, splits the matrix into square blocks, and the blocks are summed by Spark in two levels.
Every penalty of every split is then solved on a few such matrices by coordinate descent with warm starts (one task a split), and
the errors on training and test folds are quadratic forms of the same matrices, so no further pass over rows is made, and
none of it passes through the driver.

Entries are shifted by their overall means before they are multiplied, so a large constant part of a feature doesn't
cancel its spread; the intercept takes the shift up. The matrices have features x features entries, whatever the rows: beyond
``max_features`` use ``models.lasso`` on the vectors, which iterates over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.ml.sparse import feature_name
from riskpanel.ml.tuning import check_splits, split_membership

BLOCKS = "fold int, bi int, bj int, data binary"
ERRORS = "split int, role string, number int, alpha double, mse double, rmse double, r2 double, nonzero int"
COEFFICIENTS = "split int, number int, alpha double, feature string, coef double"


def shifts(rows: DataFrame, label: str, column: str = "vector") -> np.ndarray:
    """Overall means of the features and of the label: one tree-aggregated pass."""
    rows = rows.where(F.col(label).isNotNull())
    if rows.isEmpty():
        raise ValueError("no rows with a label")
    s = rows.agg(Summarizer.metrics("mean").summary(F.col(column)).alias("s"), F.avg(label).alias("y")).first()
    return np.append(s.s["mean"].toArray(), float(s.y))


def fold_products(rows: DataFrame, fold: str, label: str, shift: np.ndarray, column: str = "vector", side: int = 512,
                  max_features: int = 8192, entries: int = 4_000_000, fan: int = 32) -> DataFrame:
    """``(fold, bi, bj, data)``: blocks (bi <= bj, float64) of Z'Z per fold, where a row of Z is its shifted features, its
    shifted label and 1.

    A task makes at most ``entries`` entries dense at a time. ``rows`` holds sparse vectors as :func:`riskpanel.ml.sparse.vectors` writes them.
    """
    p = len(shift) + 1
    if p - 2 > max_features:
        raise ValueError(f"{p - 2} features: a product matrix takes {max_features} at most, use models.lasso on the vectors")
    bounds = [(lo, min(lo + side, p)) for lo in range(0, p, side)]

    def blocks(fold_no: int, total: np.ndarray):
        import pyarrow as pa
        for bi, (a, b) in enumerate(bounds):
            for bj in range(bi, len(bounds)):
                c, d = bounds[bj]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold_no], pa.int32()), pa.array([bi], pa.int32()), pa.array([bj], pa.int32()),
                     pa.array([np.ascontiguousarray(total[a:b, c:d]).tobytes()], pa.binary())], names=["fold", "bi", "bj", "data"])

    def multiply(batches: Iterator):
        fold_no, total = None, None
        for batch in batches:
            folds = np.asarray(batch.column("fold"))
            y = np.asarray(batch.column("y"))
            at, values = batch.column("at"), np.asarray(batch.column("values").flatten())
            offsets = np.asarray(at.offsets) - at.offsets[0].as_py()
            at = np.asarray(at.flatten())
            for lo in range(0, len(y), max(entries // p, 1)):
                hi = min(lo + max(entries // p, 1), len(y))
                z = np.zeros((hi - lo, p))
                own = slice(offsets[lo], offsets[hi])
                z[np.repeat(np.arange(hi - lo), np.diff(offsets[lo:hi + 1])), at[own]] = values[own]
                z[:, -2] = y[lo:hi]
                z[:, :-1] -= shift
                z[:, -1] = 1.0
                for f in np.unique(folds[lo:hi]):
                    if f != fold_no:
                        if total is not None:
                            yield from blocks(fold_no, total)
                        fold_no, total = int(f), np.zeros((p, p))
                    part = z[folds[lo:hi] == f]
                    total += part.T @ part
        if total is not None:
            yield from blocks(fold_no, total)

    def add(batches: Iterator):
        import pyarrow as pa
        key, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([total.tobytes()], pa.binary())],
                                              names=["fold", "bi", "bj", "data"])
        for batch in batches:
            for *k, data in zip(*(batch.column(c).to_pylist() for c in ("fold", "bi", "bj", "data"))):
                if k != key:
                    if total is not None:
                        yield row()
                    key, total = k, np.zeros(len(data) // 8)
                total += np.frombuffer(data)
        if total is not None:
            yield row()

    # null labels train nothing; a task turns to the next fold once it is done with one
    plain = rows.where(F.col(label).isNotNull()).select(
        F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"), F.unwrap_udt(column).alias("x")) \
        .select("fold", "y", F.col("x.indices").alias("at"), "x.values")
    parts = plain.sortWithinPartitions("fold").mapInArrow(multiply, BLOCKS)
    keys = ["fold", "bi", "bj"]
    some = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan))).repartition(*keys, "salt") \
        .sortWithinPartitions(*keys, "salt").drop("salt").mapInArrow(add, BLOCKS)
    return some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, BLOCKS)


def assemble(blocks: pd.DataFrame, p: int) -> np.ndarray:
    """The symmetric matrix of ``(bi, bj, data)`` blocks, summed over whatever folds they hold."""
    total = np.zeros((p, p))
    side = max((math.isqrt(len(d) // 8) for d, i, j in zip(blocks["data"], blocks["bi"], blocks["bj"]) if i == j == 0), default=p)
    for bi, bj, data in zip(blocks["bi"], blocks["bj"], blocks["data"]):
        rows, cols = min(side, p - bi * side), min(side, p - bj * side)
        part = np.frombuffer(data).reshape(rows, cols)
        total[bi * side:bi * side + rows, bj * side:bj * side + cols] += part
        if bi != bj:
            total[bj * side:bj * side + cols, bi * side:bi * side + rows] += part.T
    return total


def descend(gram: np.ndarray, target: np.ndarray, square: float, penalty: float, start: np.ndarray, tol: float,
            max_sweeps: int = 20_000) -> np.ndarray:
    """argmin of |y|²/2 - w't + w'Gw/2 + penalty |w|_1 by cyclic coordinate descent over an active set.

    Ends once the duality gap is at most ``tol`` |y|² (``square``). Every few sweeps the active entries are solved for their present
    signs; a solution that keeps them is exact for this set, which spares the slow end of descent among nearly equal features.
    """
    w, diag = start.copy(), np.diag(gram).copy()
    left = target - gram @ w
    usable = diag > 0
    if penalty == 0:  # least squares
        on = np.flatnonzero(usable)
        w[:] = 0.0
        w[on] = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=1e-12)[0]
        return w
    active = np.flatnonzero((w != 0) & usable)

    def gap() -> float:
        rest = max(square - w @ target - w @ left, 0.0)  # |y - Xw|²
        worst = np.abs(left[usable]).max(initial=0.0)
        scale = 1.0 if worst <= penalty else penalty / worst
        return 0.5 * rest * (1 + scale ** 2) + penalty * np.abs(w).sum() - scale * (square - w @ target)

    for sweep in range(max_sweeps):
        change = 0.0
        for j in active:
            old = w[j]
            rho = left[j] + diag[j] * old
            new = math.copysign(max(abs(rho) - penalty, 0.0), rho) / diag[j]
            if new != old:
                w[j] = new
                left -= gram[j] * (new - old)
                change = max(change, abs(new - old) * math.sqrt(diag[j]))
        settled = change <= 1e-3 * math.sqrt(tol * square)
        if not settled and sweep % 20 == 19:
            on = np.flatnonzero(w)
            signs = np.sign(w[on])
            exact = np.linalg.lstsq(gram[np.ix_(on, on)], target[on] - penalty * signs, rcond=1e-12)[0]
            if (np.sign(exact) == signs).all():
                w[on] = exact
                left = target - gram[:, on] @ exact
                settled = True
        if settled:
            if gap() <= tol * square:
                return w
            beyond = usable & (w == 0) & (np.abs(left) > penalty)
            active = np.flatnonzero(beyond | (w != 0))
    if gap() <= 1e-4 * square:  # far enough for any use, if not to ``tol``
        return w
    raise ValueError(f"coordinate descent did not settle in {max_sweeps} sweeps")


class Problem:
    """Centred and scaled cross products of some training folds, for the chosen features."""

    def __init__(self, product: np.ndarray, shift: np.ndarray, chosen: Sequence[tuple[int, str, str | None]]):
        n = product[-1, -1]
        sums = product[-1, :-1]
        centred = product[:-1, :-1] - np.outer(sums, sums) / n
        kept, dropped = [], set()
        for i, column, level in chosen:  # numerics by name, then levels by column
            if level is not None:
                if n * shift[i] + sums[i] < 0.5:  # no training row has the level
                    continue
                if column not in dropped:
                    dropped.add(column)
                    continue
            kept.append((i, column, level))
        self.at = np.array([i for i, *_ in kept], np.int64)
        self.names = [feature_name(c, v) for _, c, v in kept]
        var = np.diag(centred)[self.at] / n
        var[np.diag(centred)[self.at] <= 1e-12 * np.diag(product)[self.at]] = 0.0  # rounding of a constant
        scale = np.where([v is None for *_, v in kept], np.sqrt(var), 1.0)
        self.scale = np.where(scale > 0, scale, 1.0)
        self.gram = centred[np.ix_(self.at, self.at)] / np.outer(self.scale, self.scale)
        self.gram[var == 0, :] = self.gram[:, var == 0] = 0.0
        self.target = np.where(var > 0, centred[self.at, -1] / self.scale, 0.0)
        self.n, self.sums, self.square = n, sums, max(centred[-1, -1], 0.0)

    def path(self, alphas: Sequence[float], tol: float = 1e-10) -> dict[float, np.ndarray]:
        """Coefficients of the scaled features by penalty, solved from the largest down, each from the last one's result."""
        out, w = {}, np.zeros(len(self.at))
        for alpha in sorted(set(alphas), reverse=True):
            w = descend(self.gram, self.target, self.square, alpha * self.n, w, tol)
            out[alpha] = w
        return out

    def residual(self, w: np.ndarray) -> np.ndarray:
        """v with label - prediction = v'z for a row z of Z."""
        v = np.zeros(len(self.sums) + 1)
        v[self.at] = -w / self.scale
        v[-2] = 1.0
        v[-1] = -(v[:-1] @ self.sums) / self.n
        return v


def errors(product: np.ndarray, v: np.ndarray) -> tuple[float, float, float]:
    """mse, rmse and r2 of the residual v'z over the rows of a product matrix."""
    n = product[-1, -1]
    mse = max(float(v @ product @ v) / n, 0.0)
    var = product[-2, -2] / n - (product[-1, -2] / n) ** 2
    return mse, math.sqrt(mse), 1.0 - mse / var if var > 0 else float("nan")


def _by_split(products: DataFrame, splits: Sequence[tuple[Sequence[int], int]]) -> DataFrame:
    """Blocks with the splits that use their fold (splits x folds rows, bounded by the schedule)."""
    return products.join(F.broadcast(split_membership(products.sparkSession, splits)), "fold")


def chosen_features(index: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[int, str, str | None]]:
    """(index, column, level) of the listed columns, in the index's order: the models' own names."""
    columns = set(numeric) | set(categorical)
    return [tuple(r) for r in sorted(map(tuple, index.collect())) if r[1] in columns]


def fit_paths(products: DataFrame, index: DataFrame, shift: np.ndarray, numeric: Sequence[str], categorical: Sequence[str],
              splits: Sequence[tuple[Sequence[int], int]], alphas: Sequence[float], tol: float = 1e-10) -> DataFrame:
    """:data:`ERRORS` of every penalty on every split's training and test rows; ``number`` is the penalty's place in ``alphas``."""
    check_splits(splits)
    chosen, p = chosen_features(index, numeric, categorical), len(shift) + 1
    alphas = [float(a) for a in alphas]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        split = int(group["split"].iloc[0])
        train, test = (assemble(group[group["role"] == r], p) for r in ("train", "test"))
        out = []
        if train[-1, -1] > 0:
            problem = Problem(train, shift, chosen)
            found = problem.path(alphas, tol)
            for number, alpha in enumerate(alphas):
                v = problem.residual(found[alpha])
                out += [(split, role, number, alpha, *errors(m, v), int(np.count_nonzero(found[alpha])))
                        for role, m in (("train", train), ("test", test)) if m[-1, -1] > 0]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ERRORS.split(", ")])

    return _by_split(products, splits).groupBy("split").applyInPandas(solve, ERRORS)


def fit_folds(products: DataFrame, index: DataFrame, shift: np.ndarray, numeric: Sequence[str], categorical: Sequence[str],
              folds: Sequence[int], alphas: Sequence[float], tol: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """V5: fits on all listed folds: their :data:`ERRORS` (role ``train``) and :data:`COEFFICIENTS` (with ``intercept``)."""
    chosen, p = chosen_features(index, numeric, categorical), len(shift) + 1
    alphas = [float(a) for a in alphas]
    used = products.where(F.col("fold").isin([int(f) for f in folds])).withColumn("split", F.lit(0))

    def solved(group: pd.DataFrame):
        product = assemble(group, p)
        problem = Problem(product, shift, chosen)
        found = problem.path(alphas, tol)
        return product, problem, [(number, alpha, found[alpha]) for number, alpha in enumerate(alphas)]

    def scores(group: pd.DataFrame) -> pd.DataFrame:
        product, problem, found = solved(group)
        return pd.DataFrame([(0, "train", i, a, *errors(product, problem.residual(w)), int(np.count_nonzero(w))) for i, a, w in found],
                            columns=[c.split()[0] for c in ERRORS.split(", ")])

    def weights(group: pd.DataFrame) -> pd.DataFrame:
        _, problem, found = solved(group)
        out = []
        for i, a, w in found:
            raw = problem.residual(w)
            # in the features' own units: the shifts go into the intercept
            intercept = shift[-1] - raw[-1] + float(raw[:-2] @ shift[:-1])
            out += [(0, i, a, name, float(c)) for name, c in zip(problem.names, w)] + [(0, i, a, "intercept", intercept)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in COEFFICIENTS.split(", ")])

    return used.groupBy("split").applyInPandas(scores, ERRORS), used.groupBy("split").applyInPandas(weights, COEFFICIENTS)
