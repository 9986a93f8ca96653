"""Names of the runnable queries and of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    import importlib
    import pkgutil

    import riskloom.plans as plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"riskloom.plans.{m.name}")
