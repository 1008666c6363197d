"""Columns of any kind to numbers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom.functions.scalar import DATETIME
from planloom.operators.base import training
from planloom.operators.categories import OneHotEncoder
from planloom.operators.text import StringEncoder
from planloom.plans.runtime import Frame


@dataclass(frozen=True)
class TableVectorizer:
    """Numbers stay, timestamps become parts, texts go to ``low`` up to ``threshold`` categories and to ``high`` above."""

    threshold: int = 40
    low: Any = field(default_factory=lambda: OneHotEncoder(drop="if_binary"))
    high: Any = field(default_factory=StringEncoder)
    parts: tuple[str, ...] = ("year", "month", "day", "hour")

    def fit(self, x, y=None):
        df, _ = training(x.rows)
        kinds = {f.name: f.dataType for f in x.schema()}
        texts = [n for n, k in kinds.items() if not isinstance(k, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))]
        counted = df.agg(*[F.approx_count_distinct(x.cols[n].cast("string")).alias(str(i)) for i, n in enumerate(texts)]).first() if texts else []
        low = [n for i, n in enumerate(texts) if counted[i] <= self.threshold]
        high = [n for n in texts if n not in low]
        fitted = lambda e, names: e.fit(self._text(x, names), y) if names else None
        return kinds, (low, fitted(self.low, low)), (high, fitted(self.high, high))

    @staticmethod
    def _text(x, names):
        return Frame(x.rows, {n: x.cols[n].cast("string") for n in names})

    def transform(self, state, x):
        kinds, *encoded = state
        rows, out = x.rows, {}
        for n, k in kinds.items():
            if isinstance(k, (T.NumericType, T.BooleanType)):
                out[n] = x.cols[n].cast("double")
            elif isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                out |= {f"{n}_{p}": DATETIME[p](x.cols[n]).cast("double") for p in self.parts}
        for encoder, (names, fitted) in zip((self.low, self.high), encoded, strict=True):
            if names:
                part = encoder.transform(fitted, self._text(x, names))
                rows, out = rows.with_all(part.rows), out | part.cols
        return Frame(rows, out)
