"""Register of queries: each has a Spark plan over ``Inputs`` and, where SQL can say it, an oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentgrid.plans.fixtures import ORACLE_ONLY, SQL, Inputs, oracle_fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STEPS: dict[str, str] = {}


def oracle_step(name: str, sql: str) -> None:
    """A named subquery that several oracles share."""
    STEPS[name] = sql


def _definition(name: str) -> str | None:
    if name in STEPS:
        return STEPS[name]
    if name in SQL or name in ORACLE_ONLY:
        return oracle_fixture(name)
    return None


def with_steps(sql: str) -> str:
    """Put the subqueries that ``sql`` reads, directly or through others, in a WITH clause."""
    order: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text)):
            body = _definition(name)
            if body is not None and name not in order and name not in open_names:
                open_names.add(name)
                visit(body)
                order.append(name)

    visit(sql)
    if not order:
        return sql
    steps = ",\n".join(f"{n} AS ({_definition(n).strip()})" for n in order)
    return f"WITH {steps}\n{sql.strip()}"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def oracles() -> dict[str, str]:
    return {name: with_steps(sql) for name, sql in ORACLES.items()}
