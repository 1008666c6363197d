"""Lowering of plans to DataFrames.

A table is a base DataFrame, extensions (joins that add columns and keep rows), and a list of visible columns as
expressions over them. Renames, drops and derived columns only change that list, so columns of one table stay aligned
however they were made, and Catalyst gets one projection. Extensions of one base can be applied in any combination, so
tables that grew apart are put side by side without a join on row numbers.

Under cross-validation every row is repeated for each fold it takes part in (a narrow explode, no shuffle), marked as
training or test row of that fold. All states are then aggregates grouped by fold, and one plan scores all folds.
"""

from __future__ import annotations

import datetime
import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planloom import sources
from planloom.functions import methods, scalar
from planloom.plans.nodes import Node, Op, thaw, walk

FOLD, TEST = "__fold", "__test"
_ids = itertools.count()


def fresh(prefix: str) -> str:
    return f"__{prefix}{next(_ids)}"


def settled(df: DataFrame) -> DataFrame:
    """Materialised where the session has a shared folder for checkpoints, else cached with spill to disk."""
    has = df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getCheckpointDir()
    return df.checkpoint() if has else df.persist()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Extension:
    """Adds columns to every row of a base, keeping its rows."""

    id: int
    apply: Callable[[DataFrame], DataFrame] = field(compare=False)

    @classmethod
    def of(cls, apply: Callable[[DataFrame], DataFrame]) -> Extension:
        return cls(next(_ids), apply)


@dataclass(frozen=True, eq=False)
class Rows:
    """A base with extensions, whose columns expressions refer to by unique names.

    ``held`` has the test rows of all folds alone. Under K-folds each row is there once, where ``base`` repeats it for each fold.
    """

    base: DataFrame
    extensions: tuple[Extension, ...] = ()
    split: bool = False
    held: DataFrame | None = None
    folds: int = 1

    def df(self) -> DataFrame:
        return self._extended(self.base)

    def test(self) -> DataFrame:
        """The test rows."""
        return self._extended(self.base.where(F.col(TEST)) if self.held is None else self.held)

    def _extended(self, out: DataFrame) -> DataFrame:
        for e in self.extensions:
            out = e.apply(out)
        return out

    def extended(self, apply: Callable[[DataFrame], DataFrame]) -> Rows:
        return replace(self, extensions=(*self.extensions, Extension.of(apply)))

    def with_all(self, other: Rows) -> Rows:
        if other.base is not self.base:
            raise ValueError("columns of different tables can't be combined: join them first")
        return replace(self, extensions=(*self.extensions, *(e for e in other.extensions if e not in self.extensions)))


@dataclass(frozen=True, eq=False)
class Frame:
    rows: Rows
    cols: dict[str, Column]

    @classmethod
    def of(cls, df: DataFrame) -> Frame:
        """Columns get unique names below, so that nothing that is added can clash with them."""
        inner = {c: fresh("c") for c in df.columns}
        return cls(Rows(df.toDF(*inner.values())), {c: F.col(n) for c, n in inner.items()})

    def df(self, *more: str) -> DataFrame:
        return self.rows.df().select(*[c.alias(n) for n, c in self.cols.items()], *more)

    def schema(self) -> T.StructType:
        return self.df().schema

    def series(self, name: str) -> Series:
        if name not in self.cols:
            raise KeyError(f"no column {name!r}: the table has {', '.join(self.cols)}")
        return Series(self.rows, self.cols[name], name)

    def choose(self, names: list[str]) -> Frame:
        return Frame(self.rows, {n: self.series(n).col for n in names})

    def assign(self, columns: dict[str, Any]) -> Frame:
        rows, cols = self.rows, dict(self.cols)
        for name, value in columns.items():
            if isinstance(value, Series):
                rows = rows.with_all(value.rows)
                cols[name] = value.col
            else:
                cols[name] = F.lit(value)
        return Frame(rows, cols)

    def where(self, mask: Series) -> Frame:
        rows = self.rows.with_all(mask.rows)
        hidden = [FOLD, TEST] if rows.split else []
        inner = {n: fresh("c") for n in self.cols}
        kept = lambda df: df.where(mask.col).select(*[c.alias(inner[n]) for n, c in self.cols.items()], *hidden)
        return Frame(Rows(kept(rows.df()), split=rows.split, held=None if rows.held is None else kept(rows.test()), folds=rows.folds), {n: F.col(i) for n, i in inner.items()})


@dataclass(frozen=True, eq=False)
class Series:
    rows: Rows
    col: Column
    name: str = "value"

    def df(self, *more: str) -> DataFrame:
        return self.rows.df().select(self.col.alias(self.name), *more)

    def with_col(self, col: Column) -> Series:
        return replace(self, col=col)


def combine(func: Callable[..., Column], args: list[Any]) -> Any:
    """A function of columns, tables (column by column) and scalars."""
    frame = next((a for a in args if isinstance(a, Frame)), None)
    if frame is not None:
        out = {}
        rows = frame.rows
        for n in frame.cols:
            part = combine(func, [a.series(n) if isinstance(a, Frame) else a for a in args])
            rows, out[n] = rows.with_all(part.rows), part.col
        return Frame(rows, out)
    found = [a for a in args if isinstance(a, Series)]
    rows = found[0].rows
    for s in found[1:]:
        rows = rows.with_all(s.rows)
    return Series(rows, func(*[a.col if isinstance(a, Series) else F.lit(a) for a in args]), found[0].name)


class PlanError(RuntimeError):
    """An error in a node, with the mode and the node's name."""


@dataclass
class Context:
    """What a plan is lowered in: the session, parameter values, and the split if there is one."""

    spark: SparkSession
    environment: dict[str, Any] = field(default_factory=dict)
    splitter: Callable[[Rows, dict[str, Column]], Rows] | None = None
    folds: int = 0
    mode: str = "fit_transform"
    preview: bool = False
    memo: dict[Any, Any] = field(default_factory=dict)
    states: dict[Any, Any] = field(default_factory=dict)
    splits: dict[int, tuple[Rows, Rows]] = field(default_factory=dict)
    times: dict[str, list[float]] = field(default_factory=dict)

    def in_mode(self, mode: str) -> Context:
        return replace(self, mode=mode, memo=self.memo)

    def run(self, plan: Op | Node) -> Any:
        """The value of a plan: Frame, Series or any object. Equal nodes are lowered once for each mode."""
        root = plan.node if isinstance(plan, Op) else plan
        depends = _mode_nodes(root)
        for node in walk(root):
            key = (node, self.mode if node in depends else "")
            if key in self.memo:
                continue
            inputs = [self.memo[i, self.mode if i in depends else ""] for i in node.inputs]
            began = time.perf_counter()
            try:
                self.memo[key] = _lower(self, node, inputs)
            except PlanError:
                raise
            except Exception as e:
                raise PlanError(f"[{self.mode}] Error processing '{node.title()}': {e}") from e
            self.times.setdefault(node.title(), []).append(time.perf_counter() - began)
        return self.memo[root, self.mode if root in depends else ""]


def _mode_nodes(root: Node) -> set[Node]:
    found: set[Node] = set()
    for node in walk(root):
        if node.kind == "mode" or any(i in found for i in node.inputs):
            found.add(node)
    return found


def _lower(ctx: Context, node: Node, inputs: list[Any]) -> Any:
    params = [thaw(p, inputs) for p in node.params]
    return _LOWER[node.kind](ctx, node, *params)


def frame(value: Any) -> Frame:
    if isinstance(value, Series):
        return Frame(value.rows, {value.name: value.col})
    if not isinstance(value, Frame):
        raise TypeError(f"a table is needed, got {type(value).__name__}")
    return value


def as_value(ctx: Context, value: Any) -> Any:
    """DataFrames, of Spark or pandas, as tables."""
    if isinstance(value, DataFrame):
        return Frame.of(value)
    if type(value).__module__.startswith("pandas") and hasattr(value, "columns"):
        return Frame.of(ctx.spark.createDataFrame(value))
    return value


def _source(ctx, node, df):
    return as_value(ctx, df)


def _literal(ctx, node, value):
    return value


def _param(ctx, node, name, default):
    if name in ctx.environment:
        return as_value(ctx, ctx.environment[name])
    if default is None:
        raise KeyError(f"no value for the parameter {name!r}")
    return as_value(ctx, default)


def _scan(ctx, node, format, path, options):
    return Frame.of(sources.read(ctx.spark, format, path, **options))


def _item(ctx, node, value, key):
    if isinstance(key, Series):
        return frame(value).where(key)
    if isinstance(value, Frame):
        return value.choose(list(key)) if isinstance(key, (list, tuple)) else value.series(key)
    return value[key]


def _attribute(ctx, node, value, chain):
    for name in chain:
        if name == "dt":
            continue
        if isinstance(value, Frame):
            if name == "columns":
                value = list(value.cols)
            elif name == "shape":
                value = (value.df().count(), len(value.cols))
            else:
                raise AttributeError(f"a table has no {name!r}")
        elif isinstance(value, Series):
            if name not in scalar.DATETIME:
                raise AttributeError(f"no date attribute {name!r}")
            value = value.with_col(scalar.DATETIME[name](value.col))
        else:
            value = getattr(value, name)
    return value


def _text(ctx, node, value, name, args):
    return value.with_col(scalar.STRING[name](value.col, *args))


def _rename(ctx, node, value, columns):
    value = frame(value)
    out = {columns.get(n, n): c for n, c in value.cols.items()}
    if len(out) < len(value.cols):
        raise ValueError("two columns would have the same name")
    return Frame(value.rows, out)


def _drop(ctx, node, value, labels, errors):
    value, labels = frame(value), [labels] if isinstance(labels, str) else list(labels)
    missing = [n for n in labels if n not in value.cols]
    if missing and errors != "ignore":
        raise KeyError(f"no columns {missing}")
    return Frame(value.rows, {n: c for n, c in value.cols.items() if n not in labels})


def _assign(ctx, node, value, columns):
    return frame(value).assign({n: f(value) if callable(f) and not isinstance(f, Series) else f for n, f in columns.items()})


def _binary(ctx, node, func, a, b):
    if not any(isinstance(x, (Series, Frame)) for x in (a, b)):
        return func(a, b)
    return combine(scalar.BINARY[func], [a, b])


def _numeric(ctx, node, func, args):
    if not any(isinstance(x, (Series, Frame)) for x in args):
        return func(*args)
    if func in scalar.NUMPY:
        return combine(scalar.NUMPY[func], list(args))
    return combine(_arrow(func, {}), list(args))


#: Values by which the type of a function's results is found, and its results for some rows compared with those for all.
SAMPLE = 32
KINDS = ((bool, "boolean"), (int, "double"), (float, "double"), (str, "string"), (datetime.datetime, "timestamp"), (datetime.date, "date"))


def kind_of(results: list[Any], default: str) -> str:
    """Spark's type for values of Python or numpy; numbers are doubles."""
    for v in results:
        v = v.item() if isinstance(v, np.generic) else v
        if v is not None and v is not pd.NaT:
            return next((k for t, k in KINDS if isinstance(v, t)), default)
    return default


def _settled(values: pd.Series, kind: str) -> pd.Series:
    """Values as Arrow takes them for a type; numbers that are missing are NaN, and other values null."""
    if kind == "double":
        return values.astype("float64")
    return values.astype(object).where(values.notna(), None) if kind in ("string", "boolean", "date") else values


def _arrow(func: Callable, kwargs: dict, kind: str = "double") -> Callable[..., Column]:
    """A function of values as one of Arrow batches."""

    def run(rows: pd.DataFrame) -> pd.Series:
        values = [rows[c] for c in rows]
        if isinstance(func, np.ufunc):
            return _settled(pd.Series(func(*values, **kwargs)), kind)
        missing = "ignore" if values[0].dtype == object else None  # a number that is missing is NaN, which functions take
        return _settled(values[0].map(lambda v: func(v, **kwargs), na_action=missing), kind)

    batched = F.pandas_udf(run, kind)
    return lambda *cols: batched(F.struct(*[c.alias(f"v{i}") for i, c in enumerate(cols)]))


def _sampled(value: Series) -> pd.Series:
    return value.df().limit(SAMPLE).toPandas()[value.name]


def _by_column(value: Series, func: Callable, returns: str | None) -> Series:
    """A function of whole columns, which Arrow batches take the place of; each of its results may need its own row only."""
    sample = _sampled(value)
    found = func(sample)
    apart = [func(sample.iloc[i : i + 1]) for i in range(len(sample))]
    local = isinstance(found, pd.Series) and len(found) == len(sample) and all(isinstance(x, pd.Series) for x in apart)
    if not local or not pd.concat([*apart, found.iloc[:0]]).astype(object).fillna("").reset_index(drop=True).equals(found.astype(object).fillna("").reset_index(drop=True)):
        raise ValueError("a function of columns must give each row a value that depends on that row alone")
    kind = returns or kind_of(list(found), dict(value.df().dtypes)[value.name])
    return value.with_col(F.pandas_udf(lambda s: _settled(func(s), kind), kind)(value.col))


def _udf(ctx, node, value, func, returns, kwargs):
    if func is pd.to_datetime:
        return combine(lambda c: scalar.to_datetime(c, **{k: v for k, v in kwargs.items() if k in ("format", "errors")}), [value])
    if isinstance(value, Frame):  # a function of each column
        if isinstance(func, np.ufunc):
            return _numeric(ctx, node, func, [value])
        rows, out = value.rows, {}
        for n in value.cols:
            part = _by_column(value.series(n), lambda s: func(s, **kwargs), returns)
            rows, out[n] = rows.with_all(part.rows), part.col
        return Frame(rows, out)
    if isinstance(func, np.ufunc):
        return combine(_arrow(func, kwargs, returns or "double"), [value])
    results = (func(v, **kwargs) for v in _sampled(value).dropna()) if returns is None and not value.df().isStreaming else ()
    return combine(_arrow(func, kwargs, returns or kind_of(list(results), dict(value.df().dtypes)[value.name])), [value])


def _row_udf(ctx, node, value, func, returns):
    value, names = frame(value), list(frame(value).cols)

    def run(rows: pd.DataFrame) -> pd.Series:
        return func(rows.set_axis(names, axis=1))

    return Series(value.rows, F.pandas_udf(run, returns)(F.struct(*[c.alias(f"v{i}") for i, c in enumerate(value.cols.values())])), "value")


@dataclass(frozen=True)
class Numeric:
    """Selects numeric columns, or with ``invert`` all others."""

    invert: bool = False

    def __invert__(self) -> Numeric:
        return Numeric(not self.invert)

    def names(self, schema: T.StructType) -> list[str]:
        return [f.name for f in schema if isinstance(f.dataType, T.NumericType) != self.invert]


def _select(ctx, node, value, selector):
    value = frame(value)
    if isinstance(selector, Numeric):
        return value.choose(selector.names(value.schema()))
    return value.choose([n for n in value.cols if selector(n)] if callable(selector) else list(selector))


def _concat(ctx, node, parts, axis):
    if axis == 1:
        first, *rest = map(frame, parts)
        rows, cols = first.rows, dict(first.cols)
        for p in rest:
            rows = rows.with_all(p.rows)
            clash = set(cols) & set(p.cols)
            if clash:
                raise ValueError(f"columns are in several tables: {sorted(clash)}")
            cols |= p.cols
        return Frame(rows, cols)
    frames = [frame(p).df() for p in parts]
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for n, k in df.dtypes:
            kinds.setdefault(n, set()).add(k)
    text = {n for n, ks in kinds.items() if len(ks) > 1 and "string" in ks}  # else the union would cast text to numbers
    out = None
    for df in frames:
        df = df.withColumns({n: F.col(quoted(n)).cast("string") for n in df.columns if n in text}) if text & set(df.columns) else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return Frame.of(out)


def _method(ctx, node, value, name, args, kwargs):
    if not isinstance(value, (Frame, Series)):
        return getattr(value, name)(*args, **kwargs)
    if isinstance(value, Series) and not methods.known(name) and callable(getattr(pd.Series, name, None)):
        return _by_column(value, lambda s: getattr(s, name)(*args, **kwargs), None)
    return methods.call(value, name, args, kwargs)


def _func(ctx, node, func, args, kwargs):
    if func is pd.to_datetime and isinstance(args[0], (Frame, Series)):
        return _udf(ctx, node, args[0], func, None, kwargs)
    plain = [a.df() if isinstance(a, Frame) else a for a in args]
    return as_value(ctx, func(*plain, **kwargs))


def _subsample(ctx, node, value, n):
    return Frame.of(frame(value).df().limit(n)) if ctx.preview else value


def _mark(ctx, node, value, which):
    if ctx.splitter is None:
        return value
    rows = value.rows
    key = id(rows.base)
    if key not in ctx.splits or not set(rows.extensions) <= set(ctx.splits[key][0].extensions):
        if key in ctx.splits:
            raise ValueError("X and y must be marked before columns are added by fitted steps")
        ctx.splits[key] = (rows, ctx.splitter(rows, frame(value).cols))
    return replace(value, rows=ctx.splits[key][1])


class RejectColumn(ValueError):
    """Raised by an estimator's ``fit`` for a column that it doesn't take."""


def _fit(ctx, node, value, estimator, y, cols, how, allow_reject, unsupervised):
    if how not in ("auto", "cols", "frame", "no_wrap"):
        raise ValueError(f"how must be 'auto', 'cols', 'frame' or 'no_wrap', got {how!r}")
    value = frame(value)
    names = list(value.cols) if cols is None else [cols] if isinstance(cols, str) else cols.names(value.schema()) if isinstance(cols, Numeric) else list(cols)
    if how == "no_wrap" and cols is not None:
        raise ValueError("how='no_wrap' takes all columns")
    target = None if y is None or unsupervised else frame(y).series(next(iter(frame(y).cols)))
    out = None
    for k, group in enumerate([[n] for n in names] if how == "cols" else [names]):
        own, key = value.choose(group), (node.inputs, node.params, k)
        if key not in ctx.states:
            try:
                ctx.states[key] = estimator.fit(own, target)
            except RejectColumn:
                if not allow_reject:
                    raise
                ctx.states[key] = RejectColumn
        part = own if ctx.states[key] is RejectColumn else estimator.transform(ctx.states[key], own)
        if isinstance(part, Series) and (cols is None or how == "no_wrap") and how != "cols":
            return part
        part = frame(part)
        out = part if out is None else Frame(out.rows.with_all(part.rows), out.cols | part.cols)
    if out is None or cols is None and how != "cols":
        return value if out is None else out
    rest = {n: c for n, c in value.cols.items() if n not in names}
    return Frame(out.rows.with_all(value.rows), rest | out.cols)


def _mode(ctx, node):
    return ctx.mode


def _choice(ctx, node, labels, name):
    raise ValueError("choices are expanded before a plan runs")


_LOWER: dict[str, Callable] = {
    "source": _source, "literal": _literal, "param": _param, "scan": _scan, "item": _item, "attribute": _attribute, "text": _text, "rename": _rename, "drop": _drop,
    "assign": _assign, "binary": _binary, "numeric": _numeric, "udf": _udf, "row_udf": _row_udf, "select": _select, "concat": _concat, "method": _method, "func": _func,
    "subsample": _subsample, "mark": _mark, "fit": _fit, "mode": _mode, "choice": _choice,
}


def register(kind: str, lower: Callable) -> None:
    """Adds a node kind of one's own: ``lower(context, node, *params)``."""
    _LOWER[kind] = lower
