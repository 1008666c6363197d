"""Powers and floor division against Python's."""

import math

import numpy as np

import planloom as pl
from planloom.plans.cv import value


def test_powers_have_the_last_bit(spark):
    """Of a tenth of all numbers the last bit was off."""
    xs = [*np.random.default_rng(1).uniform(0, 0.1, 2000).tolist(), 0.0, -0.0, -1.5, math.inf, 1e300, 5e-324]
    t = pl.table(spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None])], "i int, x double"))
    out = {r.i: r for r in value(spark, t.assign(e=t["x"] ** 3, n=np.power(t["x"], 3.0), r=2 ** t["i"])).collect()}
    for i, x in enumerate(xs):
        try:
            want = repr(math.pow(x, 3))
        except OverflowError:
            want = "inf"
        assert repr(out[i].e) == repr(out[i].n) == want
    assert out[len(xs)].e is None
    assert out[10].r == 1024


def test_floor_division_of_odd_numbers(spark):
    xs = [15.0, -0.5, 0.5, -0.0, 1e300, -1e300, math.inf, -math.inf, math.nan, 2.0**63, -7.0]
    t = pl.table(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"))
    out = {r.i: r.q for r in value(spark, t.assign(q=t["x"] // 7)).collect()}
    for i, x in enumerate(xs):
        want = x / 7 if not math.isfinite(x) or x == 0 else float(math.floor(x / 7))
        assert repr(out[i]) == repr(want)
