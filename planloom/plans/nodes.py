"""Immutable plan nodes and the fluent wrapper that builds them.

A node is a kind, its input nodes and frozen parameters. Nodes that are equal by structure are the same plan, so a
dictionary keyed by nodes shares every common sub-plan.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np


@dataclass(frozen=True)
class Slot:
    """Stands in parameters for the i-th input."""

    i: int


@dataclass(frozen=True)
class Ref:
    """An object that is only equal to itself."""

    value: Any

    def __eq__(self, other):
        return isinstance(other, Ref) and other.value is self.value

    def __hash__(self):
        return id(self.value)


@dataclass(frozen=True)
class Scalar:
    """A literal that is equal to one of the same type and value: 1, 1.0 and True differ."""

    kind: type
    value: Any


def freeze(value: Any, inputs: list[Node]) -> Any:
    if isinstance(value, Op):
        value = value.node
    if isinstance(value, Node):
        if value not in inputs:
            inputs.append(value)
        return Slot(inputs.index(value))
    if isinstance(value, (list, tuple)):
        return (type(value).__name__, *(freeze(v, inputs) for v in value))
    if isinstance(value, dict):
        return ("dict", *((k, freeze(v, inputs)) for k, v in value.items()))
    try:
        hash(value)
    except TypeError:
        return Ref(value)
    if isinstance(value, float) and value != value:
        return Scalar(float, "nan")
    return Scalar(type(value), value) if isinstance(value, (bool, int, float, str, bytes, type(None))) else Ref(value) if not _by_value(value) else value


def _by_value(value: Any) -> bool:
    return callable(value) or getattr(type(value), "__dataclass_params__", None) is not None and type(value).__dataclass_params__.frozen


def thaw(value: Any, inputs: list[Any]) -> Any:
    if isinstance(value, Slot):
        return inputs[value.i]
    if isinstance(value, Scalar):
        return float("nan") if value.value == "nan" and value.kind is float else value.value
    if isinstance(value, Ref):
        return value.value
    if isinstance(value, tuple) and value and value[0] in ("list", "tuple", "dict"):
        if value[0] == "dict":
            return {k: thaw(v, inputs) for k, v in value[1:]}
        return (list if value[0] == "list" else tuple)(thaw(v, inputs) for v in value[1:])
    return value


@dataclass(frozen=True)
class Node:
    kind: str
    inputs: tuple[Node, ...] = ()
    params: tuple = ()
    label: str = field(default="", compare=False)

    def __hash__(self):
        try:
            return self.__dict__["_hash"]
        except KeyError:
            self.__dict__["_hash"] = h = hash((self.kind, self.inputs, self.params))
            return h

    def title(self) -> str:
        return self.label or f"{self.kind}({', '.join(getattr(p, '__name__', None) or str(getattr(p, 'value', p)) for p in self.params[:1])})"


def make(kind: str, *params: Any, label: str = "") -> Node:
    inputs: list[Node] = []
    frozen = tuple(freeze(p, inputs) for p in params)
    return Node(kind, tuple(inputs), frozen, label)


def walk(root: Node, breadth_first: bool = False) -> Iterator[Node]:
    """Every node once: inputs before users, or by levels from the root."""
    if breadth_first:
        queue, seen = [root], {root}
        for node in queue:
            yield node
            for i in node.inputs:
                if i not in seen:
                    seen.add(i)
                    queue.append(i)
        return
    seen: set[Node] = set()
    stack = [(root, iter(root.inputs))]
    while stack:
        node, rest = stack[-1]
        if node in seen:
            stack.pop()
            continue
        child = next((c for c in rest if c not in seen), None)
        if child is None:
            seen.add(node)
            stack.pop()
            yield node
        else:
            stack.append((child, iter(child.inputs)))


def rebuild(root: Node, change: Callable[[Node], Node]) -> Node:
    """The plan with ``change`` applied to every node, inputs first."""
    done: dict[Node, Node] = {}
    for node in walk(root):
        inputs = tuple(done[i] for i in node.inputs)
        done[node] = change(node if all(map(operator.is_, inputs, node.inputs)) else replace(node, inputs=inputs))
    return done[root]


class Accessor:
    """``.dt`` and ``.str`` of a column."""

    def __init__(self, op: Op, name: str):
        self._op, self._name = op, name

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        if self._name == "dt":
            return Op(make("attribute", self._op, ("dt", name)))
        return lambda *args: Op(make("text", self._op, name, args))


class Op:
    """A lazy value: a table, a column, or any object."""

    __array_priority__ = 1000

    def __init__(self, node: Node):
        self.node = node

    # columns and tables
    def __getitem__(self, key: Any) -> Op:
        return Op(make("item", self, key))

    @property
    def dt(self) -> Accessor:
        return Accessor(self, "dt")

    @property
    def str(self) -> Accessor:
        return Accessor(self, "str")

    @property
    def columns(self) -> Op:
        return Op(make("attribute", self, ("columns",)))

    @property
    def shape(self) -> Op:
        return Op(make("attribute", self, ("shape",)))

    def rename(self, columns: dict[str, str]) -> Op:
        return Op(make("rename", self, columns))

    def drop(self, labels: Any = None, axis: int = 1, columns: Any = None, errors: str = "raise") -> Op:
        return Op(make("drop", self, columns if columns is not None else labels, errors))

    def assign(self, **columns: Any) -> Op:
        return Op(make("assign", self, columns))

    def apply(self, func: Callable, returns: Any = None, **kwargs: Any) -> Op:
        """A function of each value of a column, or of each column of a table, given as a pandas series.

        ``returns`` is the type of its results; without it, some values tell. Functions of strings don't get nulls.
        """
        return Op(make("udf", self, func, returns, kwargs))

    def apply_rows(self, func: Callable, returns: str = "double") -> Op:
        """A function of whole rows, given as a pandas frame, that returns a series."""
        return Op(make("row_udf", self, func, returns))

    def select(self, selector: Any) -> Op:
        return Op(make("select", self, selector))

    def concat(self, others: Iterable[Op], axis: int = 0) -> Op:
        return Op(make("concat", [self, *others], axis))

    def apply_func(self, func: Callable, *args: Any, **kwargs: Any) -> Op:
        return Op(make("func", func, [self, *args], kwargs))

    def fit_apply(self, estimator: Any, y: Op | None = None, cols: Any = None, how: str = "auto", allow_reject: bool = False, unsupervised: bool = False) -> Op:
        """Applies an estimator or transformer, fitted on the training rows.

        ``how`` is ``cols`` for each column by itself, where ``allow_reject`` passes on those that it rejects; ``no_wrap`` takes
        all columns. An ``unsupervised`` estimator isn't given ``y``.
        """
        return Op(make("fit", self, estimator, y, cols, how, allow_reject, unsupervised))

    def subsample(self, n: int) -> Op:
        """The first ``n`` rows in previews; all rows in runs."""
        return Op(make("subsample", self, n))

    def mark_x(self) -> Op:
        return Op(make("mark", self, "X"))

    def mark_y(self) -> Op:
        return Op(make("mark", self, "y"))

    def named(self, label: str) -> Op:
        return Op(replace(self.node, label=label))

    # running
    def run(self, spark: Any, environment: dict | None = None) -> Any:
        from planloom.plans.cv import value

        return value(spark, self, environment)

    def preview(self, spark: Any, n: int = 10, environment: dict | None = None) -> Any:
        """The value with subsamples in effect; of a table its first ``n`` rows."""
        from planloom.plans.cv import value

        out = value(spark, self, environment, preview=True)
        return out.limit(n) if hasattr(out, "limit") else out

    def grid_search(self, spark: Any, **options: Any) -> Any:
        from planloom.plans.cv import grid_search

        return grid_search(spark, self, **options)

    def to_dot(self) -> str:
        return to_dot(self)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *args, **kwargs: Op(make("method", self, name, args, kwargs))

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        if method != "__call__" or kwargs:
            return NotImplemented
        return Op(make("numeric", ufunc, list(inputs)))

    __hash__ = None


def _binary(name: str, func: Callable, swap: bool = False):
    def method(self: Op, other: Any) -> Op:
        if func is operator.pow and not swap and type(other) is int and other == 2:
            return Op(make("numeric", np.square, [self]))
        return Op(make("binary", func, other, self) if swap else make("binary", func, self, other))

    setattr(Op, name, method)


for _name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor"):
    _func = getattr(operator, _name if _name not in ("and", "or") else f"{_name}_")
    _binary(f"__{_name}__", _func)
    _binary(f"__r{_name}__", _func, swap=True)
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    _binary(f"__{_name}__", getattr(operator, _name))
Op.__neg__ = lambda self: Op(make("numeric", np.negative, [self]))
Op.__abs__ = lambda self: Op(make("numeric", np.abs, [self]))


def table(df: Any) -> Op:
    """A Spark or pandas frame, or any other object, as a lazy value."""
    return Op(make("literal", df) if not hasattr(df, "columns") else Node("source", (), (Ref(df),)))


def scan(format: str, path: Any, **options: Any) -> Op:
    """A table in a file; path and options may be parameters."""
    return Op(make("scan", format, path, options))


def param(name: str, default: Any = None) -> Op:
    return Op(make("param", name, default))


def literal(value: Any) -> Op:
    return Op(make("literal", value))


def choose_from(options: dict[str, Any] | list[Any], name: str | None = None) -> Op:
    """One of several values; labels are the keys, or the values themselves or Opt0, Opt1, ... for plans."""
    if not isinstance(options, dict):
        options = {f"Opt{i}" if isinstance(v, (Op, Node)) or callable(v) else str(v): v for i, v in enumerate(options)}
    if not options:
        raise ValueError("a choice needs an option")
    values = [v if isinstance(v, (Op, Node)) else literal(v) for v in options.values()]
    return Op(Node("choice", tuple(v.node if isinstance(v, Op) else v for v in values), (tuple(options), name)))


def eval_mode() -> Op:
    """``fit_transform`` when a plan is fitted, ``predict`` when it predicts."""
    return Op(Node("mode"))


def to_dot(root: Op | Node) -> str:
    """The plan as a graph in DOT."""
    root = root.node if isinstance(root, Op) else root
    number = {n: i for i, n in enumerate(walk(root))}
    lines = [f'  n{i} [label="{n.title()}"];'.replace("\\", "") for n, i in number.items()]
    lines += [f"  n{number[i]} -> n{k};" for n, k in number.items() for i in n.inputs]
    return "\n".join(["digraph plan {", *lines, "}"])
