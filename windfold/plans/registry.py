"""Query registry and the SQL text of the role views used for checking."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any registered view by name."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def full_sql(body: str) -> str:
    """Prefix ``body`` with the views it uses, each after the views it needs."""
    wanted: dict[str, str] = {}
    seen: set[str] = set()

    def collect(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in seen:
                seen.add(name)
                collect(VIEWS[name])
                wanted[name] = VIEWS[name].strip()

    collect(body)
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({t})' for n, t in wanted.items())} {body}" if wanted else body
