"""The protocol of estimators and what they share."""

from __future__ import annotations

from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.plans.runtime import FOLD, TEST, Frame, Rows, Series


class Estimator(Protocol):
    """``transform`` gives a Frame for transformers and a Series for predictors."""

    def fit(self, x: Frame, y: Series | None) -> Any: ...

    def transform(self, state: Any, x: Frame) -> Frame | Series: ...


def training(rows: Rows) -> tuple[DataFrame, list[str]]:
    """The training rows, and the columns that separate the folds."""
    return (rows.df().where(~F.col(TEST)), [FOLD]) if rows.split else (rows.df(), [])


def per_fold(rows: Rows, aggregates: list[Column]) -> dict[int, Any]:
    """Aggregates of the training rows of each fold, as one row each; 0 without folds."""
    df, keys = training(rows)
    out = df.groupBy(*keys).agg(*aggregates)  # one row for each fold
    return {(r[FOLD] if keys else 0): r for r in out.collect()}


def additive(rows: Rows, cols: list[Column]) -> bool:
    """Whether statistics of each fold's training rows follow from those of the parts: under K-folds, of values that no fold's state is in."""
    return rows.held is not None and not rows.extensions and not any(FOLD in c._jc.toString() for c in cols)


def per_part(rows: Rows, aggregates: list[Column]) -> dict[int, Any]:
    """Aggregates of each part, that is of the test rows of each fold: every row counts once."""
    return {r[FOLD]: r for r in rows.test().groupBy(FOLD).agg(*aggregates).collect()}


def merged(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, covariances) of all parts together."""
    parts = [p for p in parts if p[0]]
    if not parts:
        return 0, np.zeros(0), np.zeros((0, 0))
    n = sum(p[0] for p in parts)
    mean = sum(k * m for k, m, _ in parts) / n
    return n, mean, sum(k * (c + np.outer(m - mean, m - mean)) for k, m, c in parts) / n


def train_parts(parts: dict[int, tuple], folds: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """merged() of each fold's training parts, which are all but its own; folds without training rows are left out."""
    found = {k: merged([p for part, p in parts.items() if part != k]) for k in range(folds)}
    return {k: m for k, m in found.items() if m[0]}


def by_fold(rows: Rows, values: dict[int, float]) -> Column:
    """A constant, or the constant of each fold."""
    lit = lambda v: F.lit(None if v is None else float(v)).cast("double")
    if not rows.split:
        return lit(values.get(0))
    return F.get(F.array(*[lit(values.get(k)) for k in range(max(values, default=0) + 1)]), F.col(FOLD))
