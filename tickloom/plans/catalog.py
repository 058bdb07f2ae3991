"""All registered queries of the market-data operators, by operator id in lower case."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.dialect import Operator
from tickloom.sources.market import duckdb_query, market

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with a list OPERATORS, and modules with queries() and oracle_sql() of their own.
OPERATORS = ("windows", "indicators", "aggregates", "validation", "joins", "ordering", "scalars", "engines", "flows", "backtests", "texts", "statistics", "studies", "completed", "matrix", "expectation", "steps")
QUERIES = ("tickloom.plans.streams", "tickloom.plans.archive", "tickloom.plans.series", "tickloom.plans.registries", "tickloom.plans.selection", "tickloom.plans.ingestion", "tickloom.plans.market_states", "tickloom.plans.responses")


def operators() -> dict[str, Operator]:
    out: dict[str, Operator] = {}
    for name in OPERATORS:
        for op in importlib.import_module(f"tickloom.operators.{name}").OPERATORS:
            if op.name in out:
                raise ValueError(f"{op.name} is registered already")
            out[op.name] = op
    return out


def _over_market(op: Operator) -> Query:
    return lambda spark, sf_dir: op(**market(spark, sf_dir, op.inputs()))


def queries() -> dict[str, Query]:
    out = {name: _over_market(op) for name, op in operators().items()}
    for name in QUERIES:
        more = importlib.import_module(name).queries()
        if twice := out.keys() & more.keys():
            raise ValueError(f"{name} registers again: {sorted(twice)}")
        out |= more
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: duckdb_query(op) for name, op in operators().items()}
    for name in QUERIES:
        out |= importlib.import_module(name).oracle_sql()
    return out
