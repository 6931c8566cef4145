"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: name -> (spark, sf_dir) -> DataFrame
QUERIES: dict[str, Callable[..., Any]] = {}
#: name -> DuckDB SQL over the same tables
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Register a query, with its SQL where SQL can express it."""

    def add(fn: Callable[..., Any]) -> Callable[..., Any]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
