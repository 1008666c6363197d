"""Settings of the engine, kept apart from the Spark session's."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace
from typing import Any


def parse_bool(text: str) -> bool:
    return text.strip().lower() in {"1", "true", "yes", "on"}


def from_env(name: str, default: Any) -> Any:
    """The variable PLANLOOM_<NAME> in the type of ``default``; an integer that doesn't parse keeps the default."""
    raw = os.environ.get(f"PLANLOOM_{name.upper()}")
    if raw is None:
        return default
    if isinstance(default, bool):
        return parse_bool(raw)
    if isinstance(default, int):
        try:
            return int(raw)
        except ValueError:
            return default
    return raw


@dataclass(frozen=True)
class Config:
    cse: bool = True
    algebraic_rewrites: bool = True
    log_exp: bool = True
    sqrt_square: bool = True
    udf_to_native: bool = True
    stats: bool = False
    stats_top_k: int = 10
    debug_graph: bool = False
    max_parallel_variants: int = 4

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(f.default, bool):
                if not isinstance(value, bool):
                    raise ValueError(f"{f.name} must be a boolean, got {value!r}")
            elif isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise ValueError(f"{f.name} must be an integer of at least 0, got {value!r}")


_current = Config(**{f.name: from_env(f.name, f.default) for f in fields(Config)})


def get_config() -> Config:
    return _current


def set_config(**changes: Any) -> Config:
    """Changes the named settings; all others stay."""
    global _current
    unknown = set(changes) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    _current = replace(_current, **{k: v for k, v in changes.items() if v is not None})
    return _current


@contextmanager
def config(**changes: Any) -> Iterator[Config]:
    """Settings within a ``with`` block."""
    global _current
    before = _current
    try:
        yield set_config(**changes)
    finally:
        _current = before
