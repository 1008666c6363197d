"""Plans without Spark: equality, traversal, rewrites, choices, release."""

import time

import numpy as np
import pytest

import planloom as pl
from planloom.plans.nodes import Node, make, walk
from planloom.plans.rewrite import RewriteConfig, dedupe, optimize
from planloom.plans.search import expand, release_schedule

OFF = RewriteConfig(False, False, False)


def size(plan):
    return len(list(walk(plan.node if isinstance(plan, pl.Op) else plan)))


def x():
    return pl.param("x")


def test_equality_is_structural_typed_and_ordered():
    assert (x() + 1).node == (x() + 1).node
    assert hash((x() + 1).node) == hash((x() + 1).node)
    assert (x() + 1).node != (x() + 1.0).node
    assert (x() + 1).node != (x() + True).node
    assert (x() + -1).node != (x() + -2).node
    f = max
    assert x().apply_func(f, 1, 2).node != x().apply_func(f, 2, 1).node
    assert x().apply_func(f, key=1).node != x().apply_func(f, key=2).node
    assert x().fit_apply(pl.Ridge(1.0)).node == x().fit_apply(pl.Ridge(1.0)).node
    assert x().fit_apply(pl.Ridge(1.0)).node != x().fit_apply(pl.Ridge(2.0)).node
    assert x().fit_apply(pl.Ridge(1.0), y=x()).node != x().fit_apply(pl.Ridge(1.0)).node


def test_shared_prefixes_become_one_object():
    a, b = dedupe((x() + 1) * 2, (x() + 1) * 3)
    assert a.inputs[0] is b.inputs[0]


@pytest.mark.parametrize(("build", "on", "off"), [
    (lambda v: np.exp(np.log(v)), 1, 3),
    (lambda v: np.log(np.exp(v)), 1, 3),
    (lambda v: np.log1p(np.exp(np.log(v))), 2, 4),
    (lambda v: np.sqrt(np.square(v)), 2, 3),
    (lambda v: np.sqrt(v**2), 2, 3),
    (lambda v: np.sqrt(v**3), 3, 3),
    (lambda v: np.exp(np.log(np.exp(np.log(v)))), 1, 5),
])
def test_algebraic_rewrites(build, on, off):
    assert size(optimize(build(x()))) == on
    assert size(optimize(build(x()), OFF)) == off
    with pl.config(algebraic_rewrites=False):
        assert size(optimize(build(x()))) == off


def test_a_rewrite_keeps_other_users_of_the_inner_node():
    inner = np.exp(x())
    plan = optimize(np.log(inner) + inner)
    assert size(plan) == 3


def test_user_functions_become_native():
    assert optimize(x().apply(np.sin)).kind == "numeric"
    assert optimize(x().apply(len)).kind == "udf"
    assert optimize(x().apply(np.sin), OFF).kind == "udf"


def test_traversal_orders():
    one, five, three, two = (make("literal", v, label=str(v)) for v in (1, 5, 3, 2))
    a, b = Node("add", (one, five), label="a"), Node("add", (one, two), label="b")
    c = Node("sub", (a, three), label="c")
    root = Node("add", (c, b), label="d")
    assert [n.label for n in walk(root)] == ["1", "5", "a", "3", "c", "2", "b", "d"]
    assert [n.label for n in walk(root, breadth_first=True)] == ["d", "c", "b", "a", "3", "1", "2", "5"]


def test_choices_expand_with_their_own_labels():
    v = pl.choose_from([1, 2.5], name="base") + 5
    plan = pl.choose_from({"times": v * 2, "over": v / 3}, name="f") + 1
    assert [i for i, _ in expand(plan)] == ["base:1, f:times", "base:2.5, f:times", "base:1, f:over", "base:2.5, f:over"]
    assert [i for i, _ in expand(x() + 1)] == [""]
    assert [i for i, _ in expand(pl.choose_from([x(), x() + 1]))] == ["Choice0:Opt0", "Choice0:Opt1"]
    both = pl.choose_from([1, 2], name="a") + pl.choose_from([3, 4], name="b")
    assert len(expand(both)) == 4
    once = pl.choose_from([1, 2], name="a")
    assert [i for i, _ in expand(once + once)] == ["a:1", "a:2"]
    only_one = pl.choose_from({"p": pl.choose_from([1, 2], name="in"), "q": 7}, name="out")
    assert [i for i, _ in expand(only_one)] == ["in:1, out:p", "in:2, out:p", "out:q"]
    with pytest.raises(ValueError, match="option"):
        pl.choose_from([])


def test_release_schedules():
    a = make("param", "a", None)
    b, c = Node("b", (a,)), Node("c", (Node("b", (a,)),))
    assert release_schedule([c]) == [(a, []), (b, [a]), (c, [b])]
    left, right = Node("l", (a,)), Node("r", (a,))
    top = Node("t", (left, right))
    assert release_schedule([top]) == [(a, []), (left, []), (right, [a]), (top, [left, right])]
    assert release_schedule([top], pinned=[a]) == [(a, []), (left, []), (right, []), (top, [left, right])]


def test_config(monkeypatch):
    assert pl.get_config().cse
    with pl.config(cse=False, stats_top_k=3):
        assert not pl.get_config().cse
        pl.set_config(stats=True)
        assert not pl.get_config().cse
    assert pl.get_config().cse
    assert not pl.get_config().stats
    for bad in ({"stats_top_k": -1}, {"stats_top_k": 1.5}, {"cse": 1}, {"nothing": 1}):
        with pytest.raises(ValueError):
            pl.set_config(**bad)
    from planloom.config import from_env

    for word, on in (("1", True), ("TRUE", True), ("yes", True), ("on", True), ("0", False), ("", False)):
        monkeypatch.setenv("PLANLOOM_CSE", word)
        assert from_env("cse", False) is on
    monkeypatch.setenv("PLANLOOM_STATS_TOP_K", "x")
    assert from_env("stats_top_k", 4) == 4
    assert from_env("unset", "d") == "d"


def test_dot():
    dot = pl.to_dot(np.log(x()).named("my log"))
    assert "my log" in dot
    assert "n0 -> n1" in dot


def test_peak_memory():
    from planloom.memory import PeakMemory

    with PeakMemory(every=0.02) as m:
        held = bytearray(b"x" * (100 << 20))
        time.sleep(0.3)
    assert len(m.samples) > 2
    assert m.peak - m.samples[0] >= 0
    assert m.peak >= len(held)
