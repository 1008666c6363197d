"""Scalar functions as Column expressions, with IEEE results where SQL would give null or fail."""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN, INF = float("nan"), float("inf")


def _double(c: Column) -> Column:
    return c.cast("double")


def ieee_log(c: Column) -> Column:
    """log with -inf at 0 and NaN below."""
    c = _double(c)
    return F.when(c == 0, F.lit(-INF)).when(c < 0, F.lit(NAN)).otherwise(F.ln(c))


def ieee_log1p(c: Column) -> Column:
    c = _double(c)
    return F.when(c == -1, F.lit(-INF)).when(c < -1, F.lit(NAN)).otherwise(F.log1p(c))


def _log_base(base: float) -> Callable[[Column], Column]:
    return lambda c: ieee_log(c) if base == np.e else F.when(_double(c) > 0, (F.log2 if base == 2 else F.log10)(_double(c))).otherwise(ieee_log(c))


def ieee_divide(a: Column, b: Column) -> Column:
    """Division with signed infinities and NaN at zero."""
    a, b = _double(a), _double(b)
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))).otherwise(a / b)


def floor_divide(a: Column, b: Column) -> Column:
    """A double: ``F.floor`` ends at 2^63 and makes NaN 0."""
    q = ieee_divide(a, b)
    whole = F.rint(q)
    return F.when(whole > q, whole - 1).otherwise(whole)


@F.arrow_udf(T.DoubleType())
def _power(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.power(a, b)


def power(a: Column, b: Column) -> Column:
    """The C library's pow, as Python and SQL have it; Java's differs in the last bit for about one number in ten."""
    return _power(*[_double(c) if isinstance(c, Column) else F.lit(float(c)) for c in (a, b)])


def modulo(a: Column, b: Column) -> Column:
    """The sign of the divisor, as in Python."""
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


#: Binary operators of Python on columns.
BINARY: dict[Callable, Callable[[Column, Column], Column]] = {
    operator.add: operator.add, operator.sub: operator.sub, operator.mul: operator.mul,
    operator.truediv: ieee_divide, operator.floordiv: floor_divide, operator.mod: modulo, operator.pow: power,
    operator.eq: operator.eq, operator.ne: operator.ne, operator.lt: operator.lt, operator.le: operator.le, operator.gt: operator.gt, operator.ge: operator.ge,
    operator.and_: operator.and_, operator.or_: operator.or_, operator.xor: lambda a, b: a != b,
}

#: numpy functions that run in the JVM, but for powers. The same table makes user functions native.
NUMPY: dict[Callable, Callable[..., Column]] = {
    np.log: ieee_log, np.log1p: ieee_log1p, np.log2: _log_base(2), np.log10: _log_base(10),
    np.exp: F.exp, np.expm1: F.expm1, np.sqrt: lambda c: F.sqrt(_double(c)), np.cbrt: F.cbrt, np.abs: F.abs, np.square: lambda c: c * c,
    np.sin: F.sin, np.cos: F.cos, np.tan: F.tan, np.arcsin: F.asin, np.arccos: F.acos, np.arctan: F.atan, np.sinh: F.sinh, np.cosh: F.cosh, np.tanh: F.tanh,
    np.floor: F.floor, np.ceil: F.ceil, np.rint: F.rint, np.sign: F.signum, np.negative: operator.neg, np.degrees: F.degrees, np.radians: F.radians,
    np.isnan: lambda c: F.isnan(_double(c)), np.minimum: F.least, np.maximum: F.greatest, np.power: power, np.mod: modulo, np.hypot: F.hypot, np.arctan2: F.atan2,
    np.add: operator.add, np.subtract: operator.sub, np.multiply: operator.mul, np.divide: ieee_divide,
    np.clip: lambda c, lo, hi: F.least(F.greatest(c, lo), hi),
}

_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "f": "SSSSSS", "p": "a", "I": "hh", "j": "DDD"}


def spark_pattern(strftime: str) -> str:
    """A strftime format as a pattern of Spark."""
    out, at = [], 0
    while at < len(strftime):
        ch = strftime[at]
        if ch == "%" and at + 1 < len(strftime):
            code = strftime[at + 1]
            if code != "%" and code not in _DIRECTIVES:
                raise ValueError(f"no pattern for %{code}")
            out.append(_DIRECTIVES.get(code, "%"))
            at += 2
            continue
        out.append(f"'{ch}'" if ch.isalpha() else ch)
        at += 1
    return "".join(out)


def to_datetime(c: Column, format: str | None = None, errors: str = "raise") -> Column:
    """Timestamps from text; ``coerce`` gives null where ``raise`` fails."""
    if errors not in ("raise", "coerce"):
        raise ValueError(f"errors must be 'raise' or 'coerce', got {errors!r}")
    args = [F.lit(spark_pattern(format))] if format else []
    return F.to_timestamp(c, *([spark_pattern(format)] if format else [])) if errors == "raise" else F.try_to_timestamp(c, *args)


#: Attributes of the dt accessor. Monday is weekday 0.
DATETIME: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofweek": F.weekday, "weekday": F.weekday, "dayofyear": F.dayofyear, "weekofyear": F.weekofyear, "date": F.to_date,
    "is_month_end": lambda c: F.last_day(c) == F.to_date(c), "is_month_start": lambda c: F.dayofmonth(c) == 1,
}

#: Methods of the str accessor.
STRING: dict[str, Callable[..., Column]] = {
    "len": F.length, "lower": F.lower, "upper": F.upper, "strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim, "title": F.initcap,
    "contains": lambda c, s: F.contains(c, F.lit(s)), "startswith": lambda c, s: F.startswith(c, F.lit(s)), "endswith": lambda c, s: F.endswith(c, F.lit(s)),
    "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)), "slice": lambda c, start, stop: F.substring(c, start + 1, stop - start),
}
