"""The registered queries of the library's own operators: a function over Inputs, and the same in DuckDB's SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans.views import Inputs, duck_sql

MODULES = ("scalar", "graph", "evidence", "exams", "runs", "machines", "waves", "ledger", "memory", "outcomes", "reports", "bank", "sources")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of Inputs under a name, with its oracle: SQL with names of tables and views in braces."""

    def keep(f: Callable[[Inputs], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            _ORACLES[name] = duck_sql(oracle)
        return f

    return keep


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lodestrata.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
