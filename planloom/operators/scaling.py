"""Standard scaling with statistics of the training rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.operators.base import additive, by_fold, per_fold, per_part, train_parts
from planloom.plans.runtime import Frame, RejectColumn


@dataclass(frozen=True)
class StandardScaler:
    """(x - mean) / population deviation; a constant column is only centred. Columns that are no numbers are rejected."""

    def fit(self, x, y=None):
        other = [f.name for f in x.schema() if not isinstance(f.dataType, T.NumericType)]
        if other:
            raise RejectColumn(f"no numbers: {', '.join(other)}")
        cols = list(x.cols.values())
        if additive(x.rows, cols):
            found = per_part(x.rows, [a.alias(f"{n}{i}") for i, c in enumerate(cols) for n, a in (("n", F.count(c)), ("m", F.avg(c)), ("v", F.var_pop(c)))])
            out = []
            for i in range(len(cols)):
                own = train_parts({k: (r[f"n{i}"], np.array([r[f"m{i}"]], float), np.array([[r[f"v{i}"]]], float)) for k, r in found.items()}, x.rows.folds)
                out.append(({k: float(m[0]) for k, (_, m, _) in own.items()}, {k: float(np.sqrt(c[0, 0])) or 1.0 for k, (_, _, c) in own.items()}))
            return out
        found = per_fold(x.rows, [a.alias(f"{n}{i}") for i, c in enumerate(cols) for n, a in (("m", F.avg(c)), ("s", F.stddev_pop(c)))])
        return [({k: r[f"m{i}"] for k, r in found.items()}, {k: r[f"s{i}"] or 1.0 for k, r in found.items()}) for i in range(len(cols))]

    def transform(self, state, x):
        return Frame(x.rows, {n: (c - by_fold(x.rows, m)) / by_fold(x.rows, s) for (n, c), (m, s) in zip(x.cols.items(), state, strict=True)})
