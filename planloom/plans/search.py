"""Choices: expansion into choice-free plans with their labels, and when a shared result can be released."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from planloom.plans.nodes import Node, Op, walk


def choices(root: Node) -> list[Node]:
    return [n for n in walk(root) if n.kind == "choice"]


def _values(node: Node, memo: dict[Node, list[tuple[dict[Node, str], Node]]]) -> list[tuple[dict[Node, str], Node]]:
    """All choice-free forms of a plan, each with the label taken at every choice it depends on."""
    if node in memo:
        return memo[node]
    if node.kind == "choice":
        out = [({**taken, node: label}, form) for label, option in zip(node.params[0], node.inputs, strict=True) for taken, form in _values(option, memo)]
    else:
        out = []
        for parts in product(*(_values(i, memo) for i in node.inputs)):
            taken: dict[Node, str] = {}
            if all(taken.setdefault(c, label) == label for t, _ in parts for c, label in t.items()):
                out.append((taken, rebuild_with(node, tuple(p for _, p in parts))))
    memo[node] = out
    return out


def rebuild_with(node: Node, inputs: tuple[Node, ...]) -> Node:
    return node if inputs == node.inputs else Node(node.kind, inputs, node.params, node.label)


def expand(plan: Op | Node) -> list[tuple[str, Node]]:
    """(id, plan) of every combination of the choices that a plan reaches, in the order of their options.

    An id names the outcomes of the choices in topological order, as ``name:label``; a choice without a name is ``Choice``
    and its number. A plan without choices has the id ``""``.
    """
    root = plan.node if isinstance(plan, Op) else plan
    order = {c: k for k, c in enumerate(choices(root))}
    name = {c: c.params[1] or f"Choice{k}" for c, k in order.items()}
    out = []
    for taken, form in _values(root, {}):
        out.append((", ".join(f"{name[c]}:{taken[c]}" for c in sorted(taken, key=order.get)), form))
    return out


def release_schedule(roots: Iterable[Node], pinned: Iterable[Node] = ()) -> list[tuple[Node, list[Node]]]:
    """Nodes in the order they run, each with the results that no later node needs. Roots and pinned ones stay."""
    roots = list(roots)
    order, seen = [], set()
    for root in roots:
        for node in walk(root):
            if node not in seen:
                seen.add(node)
                order.append(node)
    last = {i: k for k, node in enumerate(order) for i in node.inputs}
    keep = {*roots, *pinned}
    after: dict[int, list[Node]] = {}
    for node in order:
        if node in last and node not in keep:
            after.setdefault(last[node], []).append(node)
    return [(node, after.get(k, [])) for k, node in enumerate(order)]

