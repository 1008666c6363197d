"""Every registered query of the engine against its SQL."""

import math

import pytest

from planloom import queries


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    found = df.collect()
    assert found
    if name in queries.ORACLES:
        result = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        expected = sorted(tuple(norm(v) for v in r) for r in result.fetchall())
        assert sorted(tuple(norm(r[n]) for n in names) for r in found) == expected
