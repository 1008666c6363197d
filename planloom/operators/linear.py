"""Linear models from moments: one pass gives the covariances of every fold, and the driver solves small systems.

Moments add up, so under K-folds those of a fold's training rows come from the parts, each of whose rows is read once; only
columns with a fold's state in them, as scaled ones, take a pass over every fold's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from planloom.operators.base import additive, by_fold, per_fold, per_part, train_parts, training
from planloom.plans.runtime import FOLD, Series

#: Up to so many columns the covariances are aggregates of their own; above, Arrow batches give partial products.
FEW = 12


def moments(x, y) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(rows, means, covariances) of the features and, last, y, in the complete training rows of each fold.

    Models of the same table share one pass: the result stays with the table's rows.
    """
    columns = [*x.cols.values(), y.rows, y.col]
    kept = vars(x.rows).setdefault("_moments", {})
    key = tuple(map(id, columns))
    if key not in kept:
        kept[key] = (columns, _moments(x, y))  # the columns stay, so that their ids do
    return kept[key][1]


def _moments(x, y) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    rows = x.rows.with_all(y.rows)
    cols = [c.cast("double") for c in (*x.cols.values(), y.col)]
    parts = additive(rows, cols)
    found = _grouped(rows, cols, parts)
    return train_parts(found, rows.folds) if parts else found


def _grouped(rows, cols, parts: bool) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Moments of each part, or of the training rows of each fold."""
    p, whole = len(cols), F.lit(True)
    grouped = per_part if parts else per_fold
    for c in cols:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    cols = [F.when(whole, c) for c in cols]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    if p <= FEW:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        found = grouped(rows, [F.count(F.when(whole, 1)).alias("n"), *means, *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]])
        out = {}
        for k, r in found.items():
            cov = np.zeros((p, p))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] if r[f"c{i}_{j}"] is not None else np.nan
            out[k] = (r["n"], np.array([r[f"m{i}"] for i in range(p)], float), cov)
        return out
    found = grouped(rows, [F.count(F.when(whole, 1)).alias("n"), *means])
    centre = {k: np.array([r[f"m{i}"] or 0.0 for i in range(p)]) for k, r in found.items()}
    df, keys = (rows.test(), [FOLD]) if parts else training(rows)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            folds = b.column("k").to_numpy()
            values = np.stack([b.column(f"x{i}").to_numpy() for i in range(p)], 1)
            for k in np.unique(folds):
                v = values[folds == k] - centre[int(k)]
                total[int(k)] = total.get(int(k), 0) + v.T @ v
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(p * p, k, np.int32)), pa.array(np.arange(p * p, dtype=np.int32)), pa.array(m.ravel())], ["k", "i", "v"])

    wide = df.where(whole).select((F.col(FOLD) if keys else F.lit(0)).cast("int").alias("k"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    sums: dict[int, np.ndarray] = {k: np.zeros(p * p) for k in found}
    for r in wide.mapInArrow(products, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():  # columns squared, for each fold
        sums[r["k"]][r["i"]] = r["v"]
    return {k: (found[k]["n"], centre[k], sums[k].reshape(p, p) / max(found[k]["n"], 1)) for k in found}


def coordinate_descent(cov: np.ndarray, target: np.ndarray, l1: float, l2: float, rounds: int = 10000, tolerance: float = 1e-12) -> np.ndarray:
    """Minimises w'Cw / 2 - c'w + l1 |w| + l2 w'w / 2."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(w)):
            rest = target[i] - cov[i] @ w + cov[i, i] * w[i]
            new = np.sign(rest) * max(abs(rest) - l1, 0) / (cov[i, i] + l2) if cov[i, i] + l2 > 0 else 0.0
            moved, w[i] = max(moved, abs(new - w[i])), new
        if moved <= tolerance * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


@dataclass(frozen=True)
class LinearRegression:
    """Least squares with an intercept."""

    def solve(self, n: float, cov: np.ndarray, target: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(cov, target, rcond=None)[0]

    def fit(self, x, y):
        out = {}
        for k, (n, mean, cov) in moments(x, y).items():
            w = self.solve(n, cov[:-1, :-1], cov[:-1, -1]) if n else np.zeros(len(mean) - 1)
            out[k] = (mean[-1] - mean[:-1] @ w, w)
        return out

    def transform(self, state, x):
        total = by_fold(x.rows, {k: b for k, (b, _) in state.items()})
        for i, c in enumerate(x.cols.values()):
            total = total + c.cast("double") * by_fold(x.rows, {k: w[i] for k, (_, w) in state.items()})
        return Series(x.rows, total, "prediction")


@dataclass(frozen=True)
class Ridge(LinearRegression):
    """Squared error plus alpha times the squared weights."""

    alpha: float = 1.0

    def solve(self, n, cov, target):
        return np.linalg.solve(cov + self.alpha / n * np.eye(len(target)), target)


@dataclass(frozen=True)
class ElasticNet(LinearRegression):
    """Mean squared error / 2 plus alpha (l1_ratio |w| + (1 - l1_ratio) w'w / 2)."""

    alpha: float = 1.0
    l1_ratio: float = 0.5

    def solve(self, n, cov, target):
        return coordinate_descent(cov, target, self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio))


@dataclass(frozen=True)
class Lasso(ElasticNet):
    l1_ratio: float = 1.0


@dataclass(frozen=True)
class DummyRegressor:
    """The mean of y."""

    def fit(self, x, y):
        if additive(y.rows, [y.col]) and not x.rows.extensions:
            found = per_part(y.rows, [F.count(y.col).alias("n"), F.avg(y.col).alias("m")])
            means = train_parts({k: (r["n"], np.array([r["m"]], float), np.zeros((1, 1))) for k, r in found.items()}, y.rows.folds)
            return {k: float(m[0]) for k, (_, m, _) in means.items()}
        return {k: r["m"] for k, r in per_fold(x.rows.with_all(y.rows), [F.avg(y.col).alias("m")]).items()}

    def transform(self, state, x):
        return Series(x.rows, by_fold(x.rows, state), "prediction")
