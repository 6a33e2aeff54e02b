"""The function registry: every formula function as text that Spark SQL and DuckDB both read.

A function gets a compiler ``c`` and its arguments (``Expr``) and returns an ``Expr``. Missing values are
NULL. ``c.col(x)`` makes an argument a column, so that window functions never nest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

REGISTRY: dict[str, Function] = {}


@dataclass(frozen=True)
class Function:
    name: str
    emit: Callable
    least: int
    most: int
    kind: str
    defaults: tuple = ()
    market: tuple[str, ...] = ()
    causal: bool = True
    aliases: tuple[str, ...] = field(default=())


def function(name: str, kind: str, args: int | tuple[int, int] = 1, aliases: tuple[str, ...] = (), causal: bool = True):
    """Registers an emitter. kind: E elementwise, L lag, W window, X expanding, G islands, A array, C cross-section, R recursive."""
    least, most = args if isinstance(args, tuple) else (args, args)

    def add(emit: Callable) -> Callable:
        for n in (name, *aliases):
            if n in REGISTRY:
                raise ValueError(f"{n} is registered twice")
            REGISTRY[n] = Function(n, emit, least, most, kind, causal=causal, aliases=aliases)
        return emit

    return add
