"""Rewrites that Catalyst doesn't make, on immutable plans, until nothing changes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from planloom.config import Config, get_config
from planloom.functions.scalar import NUMPY
from planloom.plans.nodes import Node, Op, Scalar, rebuild

Rule = Callable[[Node], Node]


def _numeric(node: Node, func) -> bool:
    return node.kind == "numeric" and node.params[0] is func and len(node.inputs) == 1


def log_exp(node: Node) -> Node:
    """log(exp(x)) and exp(log(x)) are x; for x <= 0 the second is so only without the domain's NaN."""
    for outer, inner in ((np.log, np.exp), (np.exp, np.log)):
        if _numeric(node, outer) and _numeric(node.inputs[0], inner):
            return node.inputs[0].inputs[0]
    return node


def sqrt_square(node: Node) -> Node:
    """sqrt(x * x) is |x|."""
    if _numeric(node, np.sqrt) and _numeric(node.inputs[0], np.square):
        return replace(node.inputs[0], params=(np.abs, *node.inputs[0].params[1:]))
    return node


def udf_to_native(node: Node) -> Node:
    """A user function that is a numpy function of the table runs in the JVM."""
    if node.kind == "udf" and node.params[1] in NUMPY and node.params[2:] == (Scalar(type(None), None), ("dict",)):
        return Node("numeric", node.inputs, (node.params[1], ("list", node.params[0])), node.label)
    return node


@dataclass(frozen=True)
class RewriteConfig:
    """One switch for each rule."""

    log_exp: bool = True
    sqrt_square: bool = True
    udf_to_native: bool = True

    @classmethod
    def of(cls, c: Config) -> RewriteConfig:
        on = c.algebraic_rewrites
        return cls(on and c.log_exp, on and c.sqrt_square, c.udf_to_native)

    def rules(self) -> list[Rule]:
        return [r for r in (udf_to_native, log_exp, sqrt_square) if getattr(self, r.__name__)]


def optimize(plan: Op | Node, config: RewriteConfig | None = None) -> Node:
    root = plan.node if isinstance(plan, Op) else plan
    rules = (config or RewriteConfig.of(get_config())).rules()
    while True:
        before = root
        for rule in rules:
            root = rebuild(root, rule)
        if root == before:
            return root


def dedupe(*plans: Op | Node) -> list[Node]:
    """The plans with equal sub-plans as one object each."""
    table: dict[Node, Node] = {}
    return [rebuild(p.node if isinstance(p, Op) else p, lambda n: table.setdefault(n, n)) for p in plans]
