"""Methods of tables and columns under their usual data-frame names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.countDistinct, "first": F.first,
    "std": F.stddev_samp, "var": F.var_samp, "median": F.median,
}

#: Names as pandas has them; other types are Spark's.
TYPES = {"int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double", "float32": "float", "str": "string", "bool": "boolean"}


@dataclass(frozen=True, eq=False)
class Grouped:
    frame: Any
    keys: list[str]

    def agg(self, **named: tuple[str, str]) -> Any:
        """name=(column, aggregate)."""
        from planloom.plans.runtime import Frame

        inner = self.frame.cols
        aggregates = [AGGREGATES[f](inner[c]).alias(n) for n, (c, f) in named.items()]
        return Frame.of(self.frame.rows.df().groupBy(*[inner[k].alias(k) for k in self.keys]).agg(*aggregates))


def _list(names: Any) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _frame_methods() -> dict[str, Callable]:
    from planloom.plans.runtime import Frame, quoted

    def dropna(f, subset=None, how="any"):
        return Frame.of(f.df().na.drop(how=how, subset=_list(subset) if subset else None))

    def fillna(f, value):
        fills = value if isinstance(value, dict) else dict.fromkeys(f.cols, value)
        return Frame(f.rows, {n: F.coalesce(c, F.lit(fills[n])) if n in fills else c for n, c in f.cols.items()})

    def sort_values(f, by, ascending=True):
        names = _list(by)
        up = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
        return Frame.of(f.df().orderBy(*[F.col(quoted(n)).asc_nulls_last() if a else F.col(quoted(n)).desc_nulls_last() for n, a in zip(names, up, strict=True)]))

    def merge(f, other, on, how="inner"):
        return Frame.of(f.df().join(other.df(), _list(on), how))

    def drop_duplicates(f, subset=None):
        return Frame.of(f.df().dropDuplicates(_list(subset) if subset else list(f.cols)))

    def astype(f, kind):
        kinds = kind if isinstance(kind, dict) else dict.fromkeys(f.cols, kind)
        return Frame(f.rows, {n: c.cast(TYPES.get(kinds[n], kinds[n])) if n in kinds else c for n, c in f.cols.items()})

    return {
        "dropna": dropna, "fillna": fillna, "sort_values": sort_values, "merge": merge, "drop_duplicates": drop_duplicates, "astype": astype,
        "head": lambda f, n=5: Frame.of(f.df().limit(n)), "copy": lambda f: f, "groupby": lambda f, by: Grouped(f, _list(by)),
        "pipe": lambda f, func, *a, **k: func(f, *a, **k),
    }


def _clip(c: Column, lower: Any, upper: Any) -> Column:
    if lower is not None:
        c = F.greatest(c, F.lit(lower))
    return c if upper is None else F.least(c, F.lit(upper))


#: Methods that keep a column's rows.
COLUMN: dict[str, Callable[..., Column]] = {
    "isna": lambda c: c.isNull(), "notna": lambda c: c.isNotNull(), "fillna": lambda c, v: F.coalesce(c, F.lit(v)), "abs": F.abs, "round": lambda c, n=0: F.round(c, n),
    "clip": lambda c, lower=None, upper=None: _clip(c, lower, upper),
    "astype": lambda c, kind: c.cast(TYPES.get(kind, kind)), "isin": lambda c, values: c.isin(*values), "between": lambda c, lo, hi: c.between(lo, hi), "copy": lambda c: c,
}


def known(name: str) -> bool:
    """Whether a column's method is one of these; others run as those of pandas."""
    return name in COLUMN or name in AGGREGATES


def call(value: Any, name: str, args: tuple, kwargs: dict) -> Any:
    """A method by name: the table of methods, then the DataFrame's own."""
    from planloom.plans.runtime import Frame, Series, as_value

    if isinstance(value, Series):
        if name in AGGREGATES and not args:
            return value.df().agg(AGGREGATES[name](F.col("`" + value.name + "`"))).first()[0]
        if name not in COLUMN:
            raise AttributeError(f"a column has no method {name!r}")
        return value.with_col(COLUMN[name](value.col, *args, **kwargs))
    found = _frame_methods()
    if name in found:
        return found[name](value, *args, **kwargs)
    df = value.df()
    if not hasattr(df, name):
        raise AttributeError(f"a table has no method {name!r}")
    plain = [a.df() if isinstance(a, Frame) else a.col if isinstance(a, Series) else a for a in args]
    return as_value(None, getattr(df, name)(*plain, **kwargs))
