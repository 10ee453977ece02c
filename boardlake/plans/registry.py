"""Named queries over the test tables and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boardlake.plans.fixtures import SQL_TABLES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def sql(select: str, **ctes: str) -> str:
    """Assemble one statement: the fixture tables it mentions, ``ctes``, ``select``."""
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for name, body in SQL_TABLES.items():
            if name not in needed and name not in ctes and re.search(rf"\b{name}\b", text):
                visit(body)
                needed[name] = body

    for body in (*ctes.values(), select):
        visit(body)
    parts = [f"{name} AS ({body})" for name, body in {**needed, **ctes}.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select


def problems_sql(rules: dict[str, str]) -> str:
    """SQL twin of ``violations``: one row per broken rule."""
    cases = ", ".join(f"CASE WHEN ({cond}) IS DISTINCT FROM false THEN '{name}' END" for name, cond in rules.items())
    return f"unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS problem"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register
