"""Named queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dosefold.sources.star_schema import ORACLE_VIEWS, StarSchema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _needed_views(sql: str) -> list[str]:
    found: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name in ORACLE_VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                queue.append(ORACLE_VIEWS[name])
    return [name for name in ORACLE_VIEWS if name in found]


def compose_oracle(body: str, recursive: bool = False) -> str:
    """Prefix the shared views a statement mentions.

    `body` is either a plain SELECT or further ``name AS (...)`` items and a SELECT.
    """
    body = body.strip()
    plain = body.lower().startswith("select")
    views = [f"{name} AS ({ORACLE_VIEWS[name].strip()})" for name in _needed_views(body)]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if plain:
        return (head + ",\n".join(views) + "\n" if views else "") + body
    return head + ",\n".join([*views, body])


def query(name: str, oracle: str | None = None, recursive: bool = False):
    """Register ``fn(StarSchema) -> DataFrame`` under `name`."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(StarSchema(spark, folder))
        if oracle is not None:
            ORACLES[name] = compose_oracle(oracle, recursive)
        return fn

    return register


def changed(sql: str, *pairs: tuple[str, str]) -> str:
    """`sql` with each first text of a pair, which it must hold, replaced by the second: the SQL of a plan-wide query."""
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"not in the SQL: {old}")
        sql = sql.replace(old, new)
    return sql
