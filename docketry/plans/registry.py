"""Registry of runnable queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.session import tune
from docketry.sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``covers`` lists the operators of the inventory it shows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            CHECKS[name] = with_views(sql, *views) if views else sql.strip()
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    from docketry import plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"docketry.plans.{module.name}")
